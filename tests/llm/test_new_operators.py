"""Whitening, decontamination and the Merkle manifest against brute force, and on their edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldgauge.llm import covertree, leaks, merkle, queries, whitening, wrapper
from fieldgauge.session import ship_package

WORDS = re.compile(leaks.WORD)
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, g string, h string, key string, pos string"
MOST = 2**63 - 1


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ------------------------------------------------------------------------------- whitening


def usable(v):
    return v and all(e is not None and abs(e) < whitening.LARGEST for e in v)


def expected_whitening(rows, k=8):
    out = []
    for width in {len(v) for _, v in rows if usable(v)}:
        own = [(i, [int(np.floor(1024.0 * e)) + 100000 for e in v]) for i, v in rows if usable(v) and len(v) == width]
        n, s = len(own), [sum(c) for c in zip(*[x for _, x in own])]
        z = np.array([[(n * a - t) / n for a, t in zip(x, s)] for _, x in own])
        values, axes = np.linalg.eigh(z.T @ z / n)
        values, axes = values[::-1], axes[:, ::-1]
        rank = int((values > 1e-10 * max(values[0], 1e-300)).sum()) if values[0] > 0 else 0
        for (i, x), c in zip(own, z):
            d = sum((n * a - t) ** 2 for a, t in zip(x, s))
            for j in range(min(k, rank)):
                out.append((i, j + 1, n, d if d <= MOST else None, abs(c @ axes[:, j]) / np.sqrt(values[j]), values[j] / values.sum()))
    return out


def compare_whitening(df, rows):
    got = sorted(((r["vec_id"], r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in df.collect()), key=str)
    want = sorted(expected_whitening(rows), key=str)
    assert [g[:4] for g in sorted(got, key=lambda g: str(g[:4]))] == [w[:4] for w in sorted(want, key=lambda w: str(w[:4]))]
    pick = lambda rows, at: np.array([r[at] for r in sorted(rows, key=lambda r: (str(r[:4]), r[4]))])
    np.testing.assert_allclose(pick(got, 4), pick(want, 4), rtol=1e-6, atol=1e-8)
    np.testing.assert_allclose(pick(got, 5), pick(want, 5), rtol=1e-9)


def test_whitening_query_against_numpy(spark, sf):
    ship_package(spark)
    df = queries.TABLE["op11_embedding_whitening"](spark, sf).cache()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    compare_whitening(df, rows)
    errors = {r["identity_error"] for r in df.select("identity_error").distinct().collect()}
    assert len(errors) == 1 and errors.pop() < 1e-9
    y = np.array([r["whitened"] for r in df.orderBy("vec_id", "component").collect()]).reshape(-1, 8)
    assert np.abs(np.cov(y.T, bias=True) - np.eye(8)).max() < 1e-9


def test_whitening_of_odd_vectors(spark, parts):
    ship_package(spark)
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=12).tolist()) for i in range(40)]
    rows += [(40, None), (41, []), (42, [None] * 12), (43, [float("nan")] * 12), (44, [float("inf")] * 12), (45, [1e300] * 12)]
    rows += [(None, rows[3][1]), (3, rows[3][1]), (46, [0.0] * 12)]
    rows += [(50 + i, [float(i), 2.0 * i, 1.0]) for i in range(6)] + [(60, [1.0, 2.0])]  # another width of rank one, and a lone vector
    df = spark.createDataFrame([(i, v, "x", "y", 1.0) for i, v in rows], "vec_id bigint, embedding array<double>, n string, component string, whitened double")
    df = df.repartition(parts)
    compare_whitening(whitening.whiten(df, whitening.fit(df)), rows)
    none = df.where("vec_id < 0")
    assert whitening.fit(none) == {} and whitening.whiten(none, {}).count() == 0


def test_deviation_beyond_a_long(spark):
    ship_package(spark)
    rows = [(i, [float(s) * 2.0**41 * (i % 2), float(i)]) for i, s in enumerate([1, -1] * 10)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = whitening.whiten(df, whitening.fit(df)).collect()
    assert found and all(r["deviation"] is None for r in found)


def test_pivoted_factor_and_rotation():
    r = np.random.default_rng(2)
    for side, rank in ((1, 1), (7, 3), (33, 33), (40, 17)):
        a = r.normal(size=(side, rank)) * 10.0 ** r.uniform(-2, 2, size=(1, rank))
        v = a @ a.T
        low, order = whitening.cholesky(v)
        assert np.allclose(np.triu(low, 1), 0) and np.abs(low @ low.T - v[np.ix_(order, order)]).max() <= 1e-12 * np.abs(v).max()
        turned = whitening.jacobi(low)
        gram = turned.T @ turned
        assert np.abs(gram - np.diag(np.diag(gram))).max() <= 1e-12 * np.abs(gram).max()
        values, axes = whitening.eigen(v, 8)
        assert np.abs(v @ axes - axes * values).max() <= 1e-12 * values[0]
    assert whitening.eigen(np.zeros((3, 3)), 8)[0].size == 0


# -------------------------------------------------------------------------- decontamination


def item_windows(text, n=10):
    w = WORDS.findall((text or "").translate(str.maketrans(leaks.UPPER, leaks.LOWER)))
    k = min(n, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def expected_hits(text, items):
    w = WORDS.findall((text or "").translate(str.maketrans(leaks.UPPER, leaks.LOWER)))
    hit, ids = set(), set()
    for key, t in items:
        for g in item_windows(t):
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    ids.add("" if key is None else str(key))
    return len(w), hit, sorted(ids)


def leak_tables(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcXYZ09é日") for _ in range(r.randint(1, 3)))
    prose = lambda n: " ".join(word() for _ in range(n))
    long_ = prose(30)
    items = [(1, long_), (2, prose(12)), (12, "One two"), (3, None), (4, " ,; "), (None, prose(10)), (5, "a a a a a a a a a a a a"), (1, prose(11)), (6, "solo")]
    texts = [None, "", "... !", long_.upper() + " tail", "x " + items[1][1].replace(" ", "\n--") + ", one  TWO! three", "one two one two",
             prose(400), items[5][1], "a " * 40, prose(20) + " " + long_[: len(long_) // 2] + " " + prose(20), "head " + long_ + " mid. " + long_ + " end!", "solo",
             " ".join([prose(3000), long_, prose(3000)])]
    docs = [(i, t, "en", None, 1, "c", "c", "c", "c") for i, t in enumerate(texts)] + [(3, texts[3], "en", None, 1, "c", "c", "c", "c"), (None, texts[5], None, None, None, "c", "c", "c", "c")]
    return docs, items, spark.createDataFrame(docs, DOCS), spark.createDataFrame([(k, t, "q") for k, t in items], "item_id bigint, text string, n string")


@pytest.mark.parametrize("bound", [leaks.SET_BYTES, 0], ids=["broadcast", "shuffled"])
def test_contamination_against_brute_force(spark, parts, bound):
    docs, items, d, b = leak_tables(spark)
    seen = leaks.contamination(d.repartition(parts), b, bound=bound).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], [tuple(s) for s in r["spans"]], r["contaminated"]) for r in seen), key=str)
    want = []
    for row in docs:
        n, hit, ids = expected_hits(row[1], items)
        runs = [(i + 1, next(j for j in range(i, n + 1) if j not in hit) + 1) for i in sorted(hit) if i - 1 not in hit]
        want.append((row[0], n, len(hit), ids, runs, bool(hit)))
    assert got == sorted(want, key=str)
    for empty in (leaks.contamination(d.where("doc_id < 0"), b, bound=bound), leaks.contamination(d, b.where("item_id < 0"), bound=bound).where("contaminated")):
        assert empty.count() == 0


def test_spans_and_documents_are_removed(spark):
    docs, items, d, b = leak_tables(spark)
    cased = re.compile("[^" + r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F" + "]+")
    clean = {(r["doc_id"], r["text"], r["g"]) for r in leaks.scrub(d, b).collect()}
    want = set()
    for row in docs:
        _, hit, _ = expected_hits(row[1], items)
        text, out, last = row[1], [], 0
        for i, m in enumerate(cased.finditer(text or "")):
            if i not in hit:
                out.append(text[last : m.end()])
            last = m.end()
        want.add((row[0], None if text is None else "".join(out) + text[last:], "c"))
    assert clean == want
    left = sorted(leaks.scrub(d, b, remove="documents").collect(), key=str)
    assert left == sorted((r for r in d.collect() if not expected_hits(r["text"], items)[1]), key=str)
    with pytest.raises(ValueError):
        leaks.scrub(d, b, remove="half")


def test_decontamination_runs_without_python_workers(spark, sf):
    plan = queries.TABLE["op12_benchmark_decontamination"](spark, sf)._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan and "BroadcastHashJoin" in plan


# ----------------------------------------------------------------------------------- Merkle


def tree(leaves, fan):
    """The levels of a tree from its leaves to its root."""
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + fan])) for i in range(0, len(out[-1]), fan)])
    return out


def path_of(levels, i, fan):
    path = []
    for level in levels[:-1]:
        first = i - i % fan
        path.append(("".join(level[first:i]), "".join(level[i + 1 : first + fan])))
        i //= fan
    return path


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def expected_manifest(rows, fan):
    leaf = {id(r): sha("".join(field(v) for v in (r[0], r[3], r[2], r[4], r[1]))) for r in rows}
    groups = sorted({r[2] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    order = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf[id(r)])) for g in groups}
    trees = {g: tree([leaf[id(r)] for r in order[g]], fan) for g in groups}
    over = tree([trees[g][-1][0] for g in groups], fan)
    for at, g in enumerate(groups):
        for i, r in enumerate(order[g]):
            yield r[0], leaf[id(r)], path_of(trees[g], i, fan) + path_of(over, at, fan), trees[g][-1][0], over[-1][0]


@pytest.mark.parametrize("fan, depth", [(2, 2), (3, 1), (2, 10), (5, 2)])
def test_manifest_against_brute_force(spark, fan, depth):
    r = random.Random(fan)
    rows = [(i, "text %d é" % i, r.choice(["en", "en", "en", "fr", None, "é", ""]), None if i % 5 else "s", i if i % 3 else None) for i in r.sample(range(-50, 200), 90)]
    rows += [(7, None, "en", None, None), (None, "", "en", None, MOST), (None, None, None, None, None), (900, "x" * 300_000, "zz", "s", 1)]
    rows += [rows[0], rows[0], (3, "a", "en", None, 1), (3, "b", "en", None, 1)]
    df = spark.createDataFrame([(*x, "c", "c", "c", "c") for x in rows], DOCS)
    held = merkle.manifest(df, fan=fan, depth=depth).withColumn("folded", merkle.fold(F.col("claim"), F.col("path"))).collect()
    got = sorted(((h["doc_id"], h["leaf"], [tuple(s) for s in h["path"]], h["subroot"], h["root"]) for h in held), key=str)
    assert got == sorted(expected_manifest(rows, fan), key=str)
    assert all(h["folded"] == h["root"] and h["claim"] == h["leaf"] for h in held)


def test_manifest_of_no_and_one_row(spark):
    one = spark.createDataFrame([(1, "t", None, None, 1, "c", "c", "c", "c")], DOCS)
    assert merkle.manifest(one.where("doc_id < 0")).count() == 0
    row = merkle.manifest(one).first()
    assert row["path"] == [] and row["leaf"] == row["subroot"] == row["root"]


def test_tampered_rows_do_not_verify(spark, sf):
    found = queries.TABLE["op13_merkle_manifest"](spark, sf).collect()
    assert len({r["root"] for r in found}) == 1
    for r in found:
        tampered = zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
        assert r["verified"] is not tampered


# ------------------------------------------------------------------- wrappers and cover trees


def test_attributes_by_state():
    seen = lambda page: [t for _, t, _ in wrapper.blocks(page)]
    assert seen("<p>Hello <a href=x title=don't>link</a> world, it's fine</p>") == ["Hello link world, it's fine"]
    assert seen('<p>a<img alt="5" tall" src=x>b</p>') == ["ab"]
    assert seen('<p a = "x>y" b=\'<i>\' c=d/e>t</p><p "odd>z</p>') == ["t", "z"]
    assert seen('<p title="never closed>rest</p> tail') == ["rest", "tail"]
    assert seen("<p a" * 5) == [] and seen("<p " + "a=b " * 1000 + ">x") == ["x"]


def expected_fold(names):
    out, i = [], 0
    while i < len(names):
        best = (0, 1)
        for n in range(1, (len(names) - i) // 2 + 1):
            j = i + n
            while names[j : j + n] == names[i : i + n] and j + n <= len(names):
                j += n
            if j > i + n and j - i > best[0]:
                best = (j - i, n)
        out.append((tuple(names[i : i + best[1]]), "+") if best[0] else ((names[i],), "1"))
        i += best[0] or 1
    return out


def test_runs_of_any_length_fold():
    r = random.Random(9)
    for _ in range(300):
        names = [r.choice("ab") for _ in range(r.randint(0, 12))]
        item = [r.choice("abcdef") for _ in range(r.randint(1, 9))]
        names += item * r.randint(1, 4) + [r.choice("abc") for _ in range(r.randint(0, 5))]
        assert wrapper.fold(names) == expected_fold(names)
    assert wrapper.fold(list("x" + "abcdef" * 5 + "y")) == [(("x",), "1"), (tuple("abcdef"), "+"), (("y",), "1")]


def test_every_page_matches_its_hosts_expression():
    r = random.Random(10)
    for _ in range(100):
        item = [r.choice("abcdef") for _ in range(r.randint(1, 7))]
        pages = [["h"] + item * r.randint(0, 4) + [r.choice("pq") for _ in range(r.randint(0, 4))] for _ in range(6)]
        expr = []
        for names in pages:
            expr = wrapper.align(expr, wrapper.fold(names))
        matcher = wrapper.Matcher(expr)
        for names in pages:
            assert [matcher.slots[s] for s in matcher.match(names)] == names


def expected_components(ids, v, threshold=0.9):
    near = np.zeros((len(v), len(v)), bool)
    fine = [i for i, x in enumerate(v) if x and all(e is not None and np.isfinite(e) for e in x) and any(x)]
    for i in fine:
        for j in fine:
            if i != j and len(v[i]) == len(v[j]):
                a, b = np.array(v[i]), np.array(v[j])
                near[i, j] = a @ b / np.sqrt(a @ a * (b @ b)) >= threshold
    part = list(range(len(v)))
    for _ in range(len(v)):
        part = [min([part[i]] + [part[j] for j in np.flatnonzero(near[i])]) for i in range(len(v))]
    names = {c: min((ids[i] for i in range(len(v)) if part[i] == c and ids[i] is not None), default=None) for c in set(part)}
    return [(ids[i], int(near[i].sum()), names[part[i]], ids[i] == names[part[i]]) for i in range(len(v))]


def test_ids_that_repeat_or_lack(spark):
    ship_package(spark)
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [0.01, 1.0]), (None, [1.0, 0.0]), (None, [-1.0, 0.0]), (None, [-1.0, 0.0]), (4, None), (5, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id bigint, embedding array<double>, n_links string, id string")
    got = sorted(map(tuple, covertree.near_duplicates(df).collect()), key=str)
    assert got == sorted(expected_components(*zip(*rows)), key=str)


def test_cells_divided_level_by_level(spark, monkeypatch):
    ship_package(spark)
    r = np.random.default_rng(11)
    base = r.normal(size=(12, 8))
    v = np.vstack([base[r.integers(0, 12, 300)] + 0.2 * r.normal(size=(300, 8)), r.normal(size=(60, 8))])
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    links = covertree._links
    monkeypatch.setattr(covertree, "_links", lambda d, n, t: links(d, n, t, 40, 4))
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    got = sorted(map(tuple, covertree.near_duplicates(df).collect()))
    assert got == sorted(expected_components(*zip(*rows)))
