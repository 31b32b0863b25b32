"""Near-duplicate operators against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm.common import components, words
from tessera.llm.embeddings import filters_of, near_duplicates
from tessera.llm import orderhash
from tessera.llm.orderhash import _Wide, _compared, _crowd_rows, edit_distance, edits_allowed, keep_one_of_each, near_copies, rare_words, similar, sketch, tally, wide_tally, WIDE
from tessera.llm.substring import word_numbers

from .conftest import odd_texts, prose


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance():
    r = random.Random(3)
    for _ in range(300):
        a, b = ([r.randrange(4) for _ in range(r.randrange(14))] for _ in range(2))
        d, most = plain_distance(a, b), r.randrange(14)
        assert edit_distance(np.array(a), np.array(b), most) == (d if d <= most else None)


def closure(ids, linked):
    least = {i: i for i in ids}
    while True:
        after = {i: min([least[i], *(least[j] for j in linked[i])]) for i in ids}
        if after == least:
            return least
        least = after


def near_corpus():
    r, out = random.Random(9), []
    for base in range(12):
        ws = prose(base, r.choice([8, 40, 150, 600])).split()
        for _ in range(r.randint(1, 7)):
            edited = list(ws)
            for _ in range(int(len(ws) * r.choice([0, 0.02, 0.05, 0.1, 0.3]))):
                at = r.randrange(len(edited))
                edited[at : at + 1] = r.choice([[], ["zz"], [edited[at], "yy"]])
            out.append((len(out), " ".join(edited)))
    return out


def test_near_copies(spark):
    rows = near_corpus()
    split = {i: words(t) for i, t in rows}
    linked = {i: [j for j in split if j != i and similar(split[i], split[j])] for i in split}
    want = closure(split, linked)
    got = near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.component_id for r in got} == want and all(r.kept == (r.doc_id == r.component_id) for r in got)


def crowded(n, apart, passage):
    """n texts of 60 words, a common passage and own ones; text i + apart is text i with every fifth own word replaced,
    so that the two share no entry but those of the passage, which all texts share."""
    shared, out = prose(1, passage), {}
    for i in range(n):
        own = prose(1000 + i, 60 - passage).split()
        if i >= apart and 0 < i % apart < 10:
            own = [f"x{i}" if at % 5 == 2 else w for at, w in enumerate(prose(1000 + i - apart, 60 - passage).split())]
        out[i] = shared + " " + " ".join(own)
    return out


def grouped(spark, texts):
    got = near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()
    return {r.doc_id: r.component_id for r in got}


def test_near_copies_crowded(spark):
    texts = crowded(3000, 1500, 42)
    assert similar(words(texts[3]), words(texts[1503])) and not similar(words(texts[3]), words(texts[4]))
    assert grouped(spark, texts) == {i: i - 1500 if i >= 1500 and 0 < i % 1500 < 10 else i for i in texts}


def test_near_copies_none_next_to_each_other(spark):
    texts = crowded(400, 200, 24)
    meet = [i for i in range(1, 10) if set(sketch(word_numbers(words(texts[i])))) & set(sketch(word_numbers(words(texts[i + 200]))))]
    got = grouped(spark, texts)
    assert len(meet) > 5 and all(got[i + 200] == i for i in meet)


def test_near_copies_in_parts(spark, monkeypatch):
    """Crowds beyond the bound of a task are split by rare words and by parts, and lose nothing."""
    texts = crowded(400, 200, 42)
    whole = grouped(spark, texts)
    monkeypatch.setattr(orderhash, "CROWD", 30)
    assert grouped(spark, texts) == whole


def test_compared_without_keys():
    """Cells of small keys don't know the documents' other keys and leave no pair to them."""
    one = tally(word_numbers([b"a"] * 60)).tobytes()
    rows = [(7, 0, i, 60, i, one, wide_tally(word_numbers([b"a"] * 60)), 9, keys) for i, keys in ((1, None), (2, None), (3, None))]
    names = ["cell", "part", "id", "n", "c", "tally", "wide", "key", "keys"]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in list(zip(*rows))[:8]] + [pa.nulls(3, pa.list_(pa.int64()))], names=names)
    assert sum(len(b) for b in _compared(None)(iter([batch]))) == 3
    # of larger ones the lesser keys are known: a shared one leaves the pair to it
    batch = batch.set_column(8, "keys", pa.array([[5], [5], []], pa.list_(pa.int64())))
    assert [tuple(x.values()) for b in _compared(None)(iter([batch])) for x in b.to_pylist()] == [(1, 3), (2, 3)]


def test_crowd_of_common_words(spark, monkeypatch):
    """A crowd whose rarest words are common too makes no more rows than all with all in parts."""
    r = random.Random(4)
    texts = {i: " ".join(f"v{r.randrange(40)}" for _ in range(60)) for i in range(200)}
    texts |= {i + 200: texts[i].replace(texts[i].split()[7], "zz", 1) for i in range(9)}
    monkeypatch.setattr(orderhash, "CROWD", 30)
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    tallies = docs.selectExpr("id", "60 as n")
    rows = _crowd_rows(docs.selectExpr("id", "id as c"), tallies, docs).selectExpr("count(*) as n", "sum(ceil(m / 30)) as dealt").first()
    assert (rows.n, rows.dealt) == (209, 209 * 7)
    split = {i: words(t) for i, t in texts.items()}
    assert grouped(spark, texts) == closure(split, {i: [j for j in split if j != i and similar(split[i], split[j])] for i in split})


def test_wide_tallies_of_several_sizes():
    """About two places a word; texts of similar length are told apart in the places of the shorter, losing nothing."""
    assert [len(wide_tally(np.arange(n, dtype=np.uint64))) for n in (5, 60, 128, 129, 512, 513, 9000)] == [128, 128, 128, 256, 512, 1024, 2048]
    r = random.Random(6)
    for n in (5, 128, 140, 512, 530, 2100):
        ws = [b"%d" % r.randrange(400) for _ in range(n)]
        cut = ws[: n - edits_allowed(n)]
        numbers = [word_numbers(x) for x in (cut, ws)]
        counts = _Wide(pa.chunked_array([[wide_tally(x) for x in numbers]])).of(np.array([0, 1]))
        assert counts.shape[1] == 2 * len(wide_tally(numbers[0])) and np.abs(counts[0] - counts[1]).sum() + n - len(cut) <= 2 * edits_allowed(n)


def test_near_copies_of_a_template(spark):
    shared, texts = prose(1, 78).split(), {}
    for i in range(300):
        page = shared + prose(1000 + i, 22).split()
        r = random.Random(i)
        edited = list(page)
        for at in r.sample(range(100), 5):
            edited[at] = f"x{i}.{at}"
        texts[i], texts[i + 300] = " ".join(page), " ".join(edited)
    split = [words(texts[i]) for i in range(600)]
    assert not similar(split[3], split[4])
    got = grouped(spark, texts)
    assert all(got[i + 300] == got[i] for i in range(300))
    # pages are never linked but through copies that really are similar to two of them
    linked = {i: [j for j in range(600) if j != i and similar(split[i], split[j])] for i in range(600)}
    assert got == closure(range(600), linked)


def test_sketch_recall():
    """Of pairs whose share of edited words is all that SIMILARITY allows, 0.9 or more meet in an entry, at any length."""
    r = random.Random(5)
    for n, times in ((5, 200), (8, 200), (10, 200), (19, 200), (20, 200), (50, 200), (99, 200), (124, 200), (125, 200), (300, 120), (1000, 60)):
        for least in (0.8, 0.85):
            met = 0
            for t in range(times):
                a = prose(r.randrange(1 << 30), n).split()
                b = list(a)
                for at in r.sample(range(n), int((1 - least) * n + 1e-9)):
                    b[at] = f"z{t}.{at}"
                met += bool(set(sketch(word_numbers(words(" ".join(a)))).tolist()) & set(sketch(word_numbers(words(" ".join(b)))).tolist()))
            assert met >= 0.9 * times, (n, least, met)


def test_compared_beyond_a_large_group():
    one = tally(word_numbers([b"a"] * 60)).tobytes()
    rows = [(7, 0, i, 60, c, one, wide_tally(word_numbers([b"a"] * 60)), 5, [5, 9]) for i, c in [(1, 1), (2, 2), *((i, 3) for i in range(3, 403)), (500, 500)]]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["cell", "part", "id", "n", "c", "tally", "wide", "key", "keys"])
    all_ = [tuple(x.values()) for b in _compared(None)(iter([batch.slice(0, 5), batch.slice(5)])) for x in b.to_pylist()]
    assert len(all_) == len(set(all_)) == 403 * 402 // 2 - 400 * 399 // 2
    # a key that is not the least of both leaves the pair to that one
    later = batch.set_column(7, "key", pa.array([9] * len(rows)))
    assert not any(len(b) for b in _compared(None)(iter([later])))
    nearest = [tuple(x.values()) for b in _compared(0)(iter([batch])) for x in b.to_pylist()]
    assert len(nearest) == 402 and set(nearest) <= set(all_)


def test_tallies_and_rare_words_lose_nothing():
    r = random.Random(8)
    for n in [*range(5, 40), 200] * 4:
        ws = [b"%d" % r.randrange(30) for _ in range(n)]
        edited = list(ws)
        for _ in range(int(n * 0.2) + 1):
            at = r.randrange(len(edited))
            edited[at : at + 1] = r.choice([[], [b"z"], [edited[at], b"y"]])
        if similar(ws, edited):
            x, y = word_numbers(ws), word_numbers(edited)
            for a, b in ((tally(x), tally(y)), (tally(x, WIDE, 15), tally(y, WIDE, 15))):
                apart = np.abs(a.astype(int) - b).sum() + abs(len(x) - len(y))
                assert apart <= 2 * edits_allowed(max(len(x), len(y)))
            frequent = np.unique(np.concatenate([rare_words(x, x[:0], x[:0])[:3], rare_words(y, x[:0], x[:0])[:3]]))
            a, b = (rare_words(v, frequent, np.arange(1, len(frequent) + 1)) for v in (x, y))
            assert len(np.intersect1d(a, b))


def test_near_copies_odd_rows(odd, none):
    got = near_copies(odd).collect()
    assert len(got) == len(odd_texts())
    group = {r.doc_id: r.component_id for r in got}
    assert group[2] == group[1] == 1 and group[4] == 4 and group[5] == 5 and group[6] == 6 and group[14] == 14
    assert all(r.kept for r in got if r.doc_id is None)
    kept = keep_one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in odd_texts() if r[0] != 2)
    assert near_copies(none).collect() == []


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    linked = {i: [] for p in pairs for i in p}
    for a, b in pairs:
        linked[a].append(b)
        linked[b].append(a)
    got = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    want = closure(linked, linked)
    assert {r.id: r.component for r in got} == {i: c for i, c in want.items() if any(j != i for j in linked[i])}


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((120, 24)).astype(np.float32)
    near = base[:60] + rng.standard_normal((60, 24)).astype(np.float32) * 0.1
    x = np.concatenate([base, near, np.repeat(base[:1], 5, axis=0), base[1:2] * 3])
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)]
    odd = [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [None] * 24), (904, []), (None, rows[0][1]), (905, [1.0, 0.0]), (906, [1.0, 0.0])]
    got = near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").repartition(3)).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near_by = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    want = closure(range(len(u)), {i: np.flatnonzero(near_by[i]).tolist() for i in range(len(u))})
    found = {r.vec_id: r for r in got if r.vec_id is not None}
    assert all((found[i].n_links, found[i].component_id, found[i].kept) == (near_by[i].sum(), want[i], want[i] == i) for i in range(len(u)))
    assert all((found[i].n_links, found[i].component_id) == (0, i) for i in (900, 901, 902, 903, 904))
    assert (found[905].n_links, found[906].component_id) == (1, 905) and len(got) == len(rows) + len(odd)


@pytest.mark.parametrize(("dim", "least"), [(1, 1), (2, 1), (4, 1), (8, 1), (15, 1), (16, 0.99), (64, 0.99), (768, 0.99)])
def test_filters_meet(dim, least):
    rng = np.random.default_rng(4)
    x, z = rng.standard_normal((2, 400, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if dim > 1:
        z -= (z * x).sum(axis=1, keepdims=True) * x
        z /= np.linalg.norm(z, axis=1, keepdims=True)
    else:
        z = x
    y = 0.9 * x + np.sqrt(1 - 0.81) * z
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    met = [len(np.intersect1d(a, b)) > 0 for a, b in zip(filters_of(x), filters_of(y), strict=True)]
    assert np.mean(met) >= least
    assert all((np.diff(f) > 0).all() for f in filters_of(x))


def test_short_embeddings(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 4)).astype(np.float32)
    rows = [(i, [float(y) for y in v], "n", 1) for i, v in enumerate(x)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string, component_id int")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near_by = (u @ u.T >= 0.9) & ~np.eye(300, dtype=bool)
    want = closure(range(300), {i: np.flatnonzero(near_by[i]).tolist() for i in range(300)})
    assert {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(docs).collect()} == {i: (near_by[i].sum(), want[i]) for i in range(300)}
