"""The n-gram join and connected components against brute force."""

import random

import numpy as np
import pytest

from slotwise.llm import ngram_join, queries
from slotwise.llm import shingles as shingle_module
from slotwise.llm.common import components
from slotwise.llm.shingles import shingles
from tests.llm import cases


def sets_of(text, size=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ")
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < size else [tuple(words[i: i + size]) for i in range(len(words) - size + 1)])


def brute(rows):
    """doc_id: (sizes, component) over all pairs; rows of one id are one document."""
    sets = [(k, sets_of(t)) for k, t in rows]
    root = {k: k for k, _ in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {k: find(k) for k, _ in rows}, {(k, len(s)) for k, s in sets}


def check(spark, rows, **params):
    found = ngram_join.linked(cases.documents(spark, rows), **params).collect()
    want, sizes = brute(rows)
    assert len(found) == len(rows)
    assert {(r.doc_id, r.n_shingles) for r in found} == sizes
    assert {r.doc_id: r.component_id for r in found} == want


def cloud(rng, n, words=60, edits=4):
    """Near copies of one text, each changed here and there, beside texts that share a passage."""
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    passage = [f"p{k}" for k in range(40)]
    rows = []
    for k in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(words)] = f"e{rng.randrange(10_000)}"
        rows.append((k, " ".join(own)))
    rows += [(n + k, " ".join(passage + [f"q{rng.randrange(10_000)}" for _ in range(rng.randrange(30))])) for k in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, params", [
    (1, {}), (2, {"common_groups": 1}), (3, {"common_groups": 2, "most_common": 3}), (4, {"common_groups": 10**6}),
])
def test_clouds_of_near_copies(spark, seed, params):
    check(spark, cloud(random.Random(seed), 60), **params)


def test_query_matches_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{cases.SF}/documents.parquet").select("doc_id", "text").collect()]
    want, sizes = brute(docs)
    found = queries.op4_ngram_join(spark, cases.SF).collect()
    assert {r.doc_id: r.component_id for r in found} == want and {(r.doc_id, r.n_shingles) for r in found} == sizes


def test_awkward_rows(spark):
    ten = "a b c d e f g h i j"
    df = cases.odd(spark, ["Few words", "few\x0bWORDS ", (20, ten), (9, "x y z 1 2 3"), (20, "x  y z 1 2 3"), (30, ten), "É x", "é x"])
    found = ngram_join.linked(df).collect()
    assert len(found) == df.count()
    by = {r.doc_id: r for r in found}
    assert [by[k].component_id for k in (0, 1, 2)] == [0, 1, 2] and by[0].n_shingles == by[1].n_shingles == by[2].n_shingles == 0
    assert by[None].component_id is None and by[4].n_shingles == len(sets_of(cases.LONG))
    assert by[8].component_id == by[9].component_id == 8 or by[8].n_shingles == 1
    assert by[20].component_id == by[30].component_id == by[9].component_id  # one id with two texts ties both
    assert ngram_join.linked(cases.empty(spark)).count() == 0


def test_one_of_each(spark):
    df = cases.documents(spark, [None, "", "a b c d e f", (7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), "z y x"])
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["0", "1", "2", "6", "None"]


@pytest.mark.parametrize("text", ["", "one", "A b C d", "a b c d e", "Ä ä b\tc\nd\x0be f", "x y z", "a " * 3000])
def test_shingle_sets(text):
    assert len(shingles(text)) == len(sets_of(text))


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(100, 160)] + [(0, k) for k in range(1, 50)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    edges += [tuple(rng.sample(range(1000, 1100), 2)) for _ in range(60)]
    rng.shuffle(edges)
    root = {k: k for e in edges for k in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    found = dict(components(spark.createDataFrame(edges, "a long, b long"), "test").collect())
    assert found == {k: v for k, v in root.items() if k != 300}
    assert components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


def thue_morse(n, letters):
    return "".join(letters[bin(k).count("1") % 2] for k in range(n))


def test_words_made_to_hash_alike_are_told_apart(spark):
    rows = [(k, thue_morse(n, letters)) for k, (n, letters) in enumerate((n, x) for n in (64, 128, 1024, 4096) for x in ("ab", "ba"))]
    rows += [(20, "one two three four " + rows[4][1]), (21, "one two three four " + rows[5][1])]
    assert len({int(shingles(t)[0]) for _, t in rows}) == len(rows)
    found = ngram_join.linked(cases.documents(spark, rows)).collect()
    assert all(r.component_id == r.doc_id for r in found)


@pytest.mark.parametrize("together", [1, 7, 100, 1 << 14])
def test_long_texts_have_the_shingles_of_their_parts(monkeypatch, together):
    text = " ".join(f"w{k % 50}" if k % 9 else "x" * (k % 150) for k in range(400))
    want = {s for s in sets_of(text)}
    monkeypatch.setattr(shingle_module, "TOGETHER", together)
    assert len(shingles(text)) == len(want)
    assert (shingles(text) == shingles(text.upper().replace("X", "x"))).all()
    monkeypatch.setattr(shingle_module, "TOGETHER", 1 << 14)
    whole = shingles(text)
    monkeypatch.setattr(shingle_module, "TOGETHER", together)
    assert (shingles(text) == whole).all() and len(shingles("")) == len(shingles(" \n")) == 0


def test_a_cloud_without_links_is_not_compared_pair_by_pair(spark, monkeypatch):
    """Texts that share two thirds: one group, but no set may link to a block's union."""
    rng = random.Random(3)
    shared = [f"s{k}" for k in range(80)]
    texts = [" ".join(shared + [f"u{rng.randrange(10**9)}" for _ in range(45)]) for _ in range(300)]
    sets = [shingles(t) for t in texts]
    compared = []
    real = ngram_join._products
    monkeypatch.setattr(ngram_join, "_products", lambda row, column, n, left, same: compared.append(left * (n - left)) or real(row, column, n, left, same))
    for one, two, same in ((sets[:150], sets[150:], False), (sets, sets, True)):
        assert len(ngram_join._linked_pairs(one, two, 80, same)[0]) == 0
    assert sum(compared) == 0
    near = [" ".join(shared + [f"v{k}"] + t.split()[80:]) for k, t in enumerate(texts[:5])]
    x, y = ngram_join._linked_pairs(sets, [shingles(t) for t in near], 80)
    assert sorted(zip(x.tolist(), y.tolist())) == [(k, k) for k in range(5)] and sum(compared) == 25
    check(spark, list(enumerate(texts[:60] + near)))


def test_pairs_of_sets_against_brute_force():
    rng = random.Random(8)
    for _ in range(60):
        universe = rng.randint(3, 40)
        sets = [np.unique(np.array(rng.choices(range(universe), k=rng.randint(0, 30)), dtype=np.uint64)) for _ in range(rng.randint(1, 14))]
        cut = rng.randint(0, len(sets))
        for one, two, same in ((sets[:cut], sets[cut:], False), (sets, sets, True)):
            got = set(zip(*(k.tolist() for k in ngram_join._linked_pairs(one, two, 80, same))))
            want = {
                (i, j) for i, x in enumerate(one) for j, y in enumerate(two)
                if len(x) and len(y) and 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))
            }
            if same:  # a set that shares too little with all others is not met by itself
                got, want = ({(i, j) for i, j in pairs if i != j} for pairs in (got, want))
            assert got == want


def test_few_texts_at_a_time(spark, monkeypatch):
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, plain = spark.conf.get(key), ngram_join.stored
    monkeypatch.setattr(ngram_join, "stored", lambda df, label: seen.append(int(spark.conf.get(key))) or plain(df, label))
    check(spark, [(k, f"a b c d e f{k % 7}") for k in range(40)])
    assert seen and max(seen) <= ngram_join.ARROW_ROWS < int(before)
    assert spark.conf.get(key) == before
