"""Where tables come from and go to. Every fact scan takes its time range."""
