"""The dealt operators on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldgauge.llm import chat, components, covertree, jaccard, langid, packing, pieces, quality, queries, repeats, suffixes, unigram, wordpiece, wrapper
from fieldgauge.session import ship_package

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = queries.tokenizer_file("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, t string, id string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["an", "the", "ing", "sol", "ré", "ü"]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    long_ = prose(1, 6000)
    base = prose(2, 120)
    return [
        None, "", " \n ", "one", "one", "a b c d", base, base, base.replace("the", "thy", 1), base[:400] + prose(3, 60), base[:400] + prose(4, 60),
        long_, "x " * 300, "Größe 日本語 𝄞 ▁ \x00 <|endoftext|> it's", "l1\nl1\nl2\n\nl1", prose(5, 80) + "\n" + prose(6, 80),
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    ship_package(spark)
    rows = [(i, t, "en" if i % 2 else None, None, None, "clash", "clash", "clash") for i, t in enumerate(texts)]
    rows.append(rows[6])  # the same row again
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def expected_measures(text):
    words = WORD.findall(text or "")
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(5)}
    lines = Counter(line for line in (text or "").split("\n") if WORD.search(line))
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), sum(n - 1 for n in lines.values()), len(covered)


def test_quality_ledger(docs, nothing, texts):
    rows = quality.ledger(docs).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected_measures(texts[r.doc_id])
    book = quality.judge(quality.ledger(docs), quality.POLICIES["v2"])
    cost = {r.rule: r for r in quality.ablate(book, quality.POLICIES["v2"]).collect()}
    kept = book.where("kept").count()
    for i, rule in enumerate(quality.RULES):
        bits = [r.failed_bits for r in rows]
        assert cost[rule.name].n_failed == sum(b >> i & 1 for b in bits)
        assert cost[rule.name].n_kept_without == kept + cost[rule.name].n_only == sum(not b & ~(1 << i) for b in bits)
    assert quality.ledger(nothing).count() == 0


def test_chat_round_trip(spark):
    probe = "\\### Assistant: </turn> ok\\h\\b\\\\l"
    rows = [(1, 0, "user", probe, 1), (1, 1, "assistant", probe, 1), (2, 0, "user", None, 1), (2, 1, None, "x: y", 1), (None, None, "a:b#", "", 1),
            (3, 0, "assistant", "é", 1), (3, 0, "assistant", "é", 1)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, valid int")
    whole = chat.join_turns(chat.format_turns(table)).withColumn("turns", chat.parse(F.col("formatted")))
    got = {r.conv_id: r for r in whole.collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", probe), ("assistant", probe)] and got[1].valid
    assert [tuple(t) for t in got[2].turns] == [("user", ""), ("", "x: y")] and not got[2].valid
    assert [tuple(t) for t in got[None].turns] == [("a:b#", "")]
    assert got[3].n_turns == 2 and not got[3].valid and got[3].trained == "éé"
    assert whole.where("conv_id = 1").select(chat.unescape(F.col("trained"))).first()[0] == probe
    assert chat.join_turns(chat.format_turns(table.limit(0))).count() == 0


def greedy(word, known):
    n = 0
    while word:
        k = next((k for k in range(len(word), 0, -1) if word[:k] in known), 0)
        if not k:
            return 1
        word, n = word[k:], n + 1
    return n


def test_longest_match_automaton(docs, nothing):
    r = random.Random(5)
    for _ in range(200):
        known = {"".join(r.choice("ab") for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 8))}
        later = {"".join(r.choice("ab") for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 6))}
        same, two = wordpiece.Automaton(known, known), wordpiece.Automaton(known, later)
        for _ in range(10):
            w = "".join(r.choice("ab") for _ in range(r.randint(1, 12)))
            assert same.count(w) == greedy(w, known)
            k = next((k for k in range(len(w), 0, -1) if w[:k] in known), 0)
            rest = greedy(w[k:], later)
            good = k and (not w[k:] or rest > 1 or w[k:] in later)
            assert two.count(w) == (1 + rest * bool(w[k:]) if good else 1)
    automaton = wordpiece.word_end_automaton(VOCABULARY)
    got = {r.doc_id: r for r in wordpiece.token_counts(docs, automaton).collect()}
    letter = wordpiece.byte_letters()
    for row in docs.collect():
        words = pieces.PATTERN.findall(pieces.normal(row.text or ""))
        count = sum(automaton.count("".join(letter[b] for b in w.encode())) for w in words)
        assert (got[row.doc_id].n_words, got[row.doc_id].n_tokens) == (len(words), count)
    assert wordpiece.token_counts(nothing, automaton).count() == 0


def test_language(spark, nothing, docs):
    ship_package(spark)
    r = random.Random(3)
    word = {"aa": ["lor", "kip", "tan"], "bb": ["sch", "ung", "heit"]}
    rows = [(i, " ".join(r.choice(word[k]) + r.choice(word[k]) for _ in range(30)), k) for i in range(300) for k in [r.choice(["aa", "bb"])]]
    table = spark.createDataFrame([*rows, (900, None, "aa"), (901, "123 ,.", "bb"), (902, "x", None)], "doc_id bigint, text string, lang string")
    model = langid.fit(table.where(~langid.held_out()))
    got = {x.doc_id: x for x in langid.predict(table, model).collect()}
    held = [(i, k) for i, _, k in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert held and all(got[i].lang_pred == k and 0 <= got[i].score <= 1 for i, k in held)
    assert got[900].lang_pred == got[901].lang_pred == "und" and (model.weights == 0).mean() > 0.5
    assert langid.predict(nothing, langid.fit(nothing)).count() == 0
    assert {x.lang_pred for x in langid.predict(docs, langid.fit(nothing)).collect()} == {"und"}


def test_cover_tree(spark, monkeypatch):
    ship_package(spark)
    monkeypatch.setattr(covertree, "BLOCK", 40)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 8))
    x = np.concatenate([x, x[:30] + 0.15 * rng.normal(size=(30, 8)), x[:5], 3 * x[5:8], x[:20] + 0.3 * rng.normal(size=(20, 8))]).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(1000, None, 1), (1001, [0.0] * 8, 1), (1002, [1.0, None] + [0.0] * 6, 1), (1003, [float("nan")] + [1.0] * 7, 1), (1004, [1.0, 2.0], 1), (1005, [], 1)]
    table = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, n_links int").repartition(4)
    got = {r.vec_id: r for r in covertree.near_duplicates(table).collect()}
    y = x.astype(np.float64)
    y /= np.sqrt((y * y).sum(axis=1, keepdims=True))
    near = y @ y.T >= 0.9
    i, j = np.nonzero(near)
    root = components.hook(np.arange(len(y)), i, j)
    assert [got[k].n_links for k in range(len(y))] == (near.sum(axis=1) - 1).tolist()
    assert [got[k].component_id for k in range(len(y))] == root.tolist()
    assert all(got[o[0]].n_links == 0 and got[o[0]].kept for o in odd)
    assert covertree.near_duplicates(table.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies</div><div id=wrap><div class="x"><h1>Title %d &amp; more</h1>
<p>Text %d   with <b>bold</b>&nbsp;x<p>Second<br>line %d<ul><li>one %d<li>two</ul></div><aside>side</aside><div class=comments><p>nice</p></div></div>
<form><input>Name</form><script>if (a<b) "</p>"</script><!-- <p>no</p> --><footer>(c)</footer>"""


def test_wrappers(spark):
    ship_package(spark)
    rows = [(i, f"https://h.example/{i}", PAGE % (i, i, i, i), "clash") for i in range(5)]
    article = "<body><div>menu</div><article><h1>A</h1><p><b>B<br><p>C</article><footer>f</footer>"
    rows += [(10, "http://o.example", article, ""), (11, None, None, ""), (12, "http://o.example/x", "", ""), (13, "http://p.example", "<p>cut <b", ""), (10, "http://o.example", article, "")]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string").repartition(3)
    got = {r.page_id: r for r in wrapper.extract(table).collect()}
    for i in range(5):
        assert got[i].text == f"Title {i} & more\n\nText {i} with bold x\n\nSecond line {i}\n\none {i}\n\ntwo"
    assert got[10].text == "A\n\nB\n\nC" and got[11].text == got[12].text == "" and got[13].text == "cut"
    assert wrapper.extract(table).count() == len(rows) and wrapper.extract(table.limit(0)).count() == 0
    assert wrapper.fold(list("abcbcbcd")) == [(("a",), "1"), (("b", "c"), "+"), (("d",), "1")]
    merged = wrapper.align(wrapper.fold(list("abd")), wrapper.fold(list("abbcd")))
    assert merged == [(("a",), "1"), (("b",), "+"), (("c",), "?"), (("d",), "1")]


def extracted(spark, pages):
    ship_package(spark)
    table = spark.createDataFrame([(i, f"http://{h}.example/{i}", html) for i, (h, html) in enumerate(pages)], "page_id bigint, url string, html string")
    return [r.text for r in wrapper.extract(table.repartition(3)).orderBy("page_id").collect()]


def test_wrapper_decides_by_slot(spark):
    matcher = wrapper.Matcher([(("a",), "?"), (("p",), "+"), (("b", "c"), "*"), (("h",), "1"), (("p",), "1")])
    assert matcher.match(list("pphp")) == [1, 1, 4, 5] and matcher.match(list("apbcbchp")) == [0, 1, 2, 3, 2, 3, 4, 5]
    # one path, two slots: only the place in the expression tells the standing line below the rule from the text
    flat = "<body><p>Text %d of the page<p>More %d of it<h4>Note</h4><p>All rights are kept by the house</body>"
    assert extracted(spark, [("a", flat % (i, i)) for i in range(4)]) == [f"Text {i} of the page\n\nMore {i} of it" for i in range(4)]
    # an article element with a standing line is not the text
    other = "<body><article><p>Welcome to the house</article><div><p>Text %d of the page</div></body>"
    assert extracted(spark, [("a", other % i) for i in range(4)]) == [f"Text {i} of the page" for i in range(4)]


@pytest.mark.parametrize("wrap", ['div class="layout has-sidebar"', 'div class="elementor-widget-container"', 'div id="form-wrapper"', 'div class="page with-banner"', "form", 'div class="with-comments"'])
@pytest.mark.parametrize("inner", ["article", "div"])
def test_wrapper_class_words(spark, wrap, inner):
    html = f"<body><{wrap}><{inner}><p>The text %d of the page is the longest</{inner}><div class=sidebar><p>Short aside %d</div></{wrap.split()[0]}><div class=ad>Ad %d</div></body>"
    got = extracted(spark, [("a", html % (i, i, i)) for i in range(4)])
    if "comments" in wrap and inner == "div":  # nothing but class words: all that is there, rather than nothing
        assert all(f"The text {i} of the page is the longest" in t for i, t in enumerate(got))
    else:
        assert got == [f"The text {i} of the page is the longest" for i in range(4)]


def test_wrapper_copies_and_layouts(spark):
    copy = "<body><nav><a href=x>Home %d</a></nav><div><h2>Kept title</h2><p>Kept text of all the copies</div><div class=ad>Ad %d</div></body>"
    common = "<body><section class=intro><p>Intro %d</section><section class=body><p>Text %d of the page, which is longer<p>And on</section><div><p>Same line on all pages</div></body>"
    rare = "<body><center><table><tr><td><p>Rare layout %d with its own text</td></tr></table></center></body>"
    for n in (1, 2, 3, 6):
        pages = [("c", copy % (i, i)) for i in range(n)] + [("s", common % (i, i)) for i in range(5)] + [("s", common % (0, 0))] * n + [("s", rare % n)]
        got = extracted(spark, pages)
        assert got[:n] == ["Kept title\n\nKept text of all the copies"] * n
        assert got[n : n + 5] == [f"Intro {i}\n\nText {i} of the page, which is longer\n\nAnd on" for i in range(5)]
        assert got[n + 5 :] == [got[n]] * n + [f"Rare layout {n} with its own text"]


def test_packing(docs, nothing, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 2)
    rows = packing.pack(docs, VOCABULARY).collect()
    encoder = packing.Encoder(VOCABULARY)
    ids = {r.doc_id: np.array([*encoder.tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4") for r in docs.collect()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, spans in by_doc.items():
        assert Counter(k for s, n in spans for k in range(s, s + n)) == Counter({k: 1 + (doc == 6) for k in range(len(ids[doc]))})
    short = 0
    for spans in by_sequence.values():
        spans.sort()
        assert all(b == a + n for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0
        total = sum(n for _, n in spans)
        assert total <= 4096
        short += total not in packing.TIERS
    assert short <= 1 and packing.pack(nothing, VOCABULARY).count() == 0


def pairs_by_force(texts, threshold=0.8):
    sets = []
    for t in texts:
        w = WORD.findall(t or "")
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])]


@pytest.mark.parametrize("block", [2, 256])
def test_jaccard(spark, docs, nothing, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    r = random.Random(8)
    base = prose(9, 150).split()
    texts = [None, "", "a b", "a  b", "a b c"]
    for i in range(40):
        w = list(base) if i % 2 else prose(10 + i, 90).split()
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = "edit%d" % r.randrange(3)
        texts.append(" ".join(w))
    texts += texts[5:9]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, id string, n int").repartition(3)
    got = {x.doc_id: x for x in jaccard.join(table).collect()}
    pairs = pairs_by_force(texts)
    links = Counter(k for p in pairs for k in p)
    root = components.hook(np.arange(len(texts)), np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    assert [got[i].n_links for i in range(len(texts))] == [links[i] for i in range(len(texts))]
    assert [got[i].class_id for i in range(len(texts))] == root.tolist()
    assert jaccard.join(docs).count() == docs.count() and jaccard.join(nothing).count() == 0


def test_bayes_bounds():
    least = jaccard.needed()
    n = jaccard.HASHES
    drop = sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(least[-1]))
    assert drop < 1e-4 and least == sorted(least) and least[-1] > 0.5 * n


def removed_by_force(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in raw for i in range(len(d) - length + 1))
    out = []
    for d in raw:
        mark = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        out.append((len(d), sum(mark), hashlib.sha256(bytes(b for b, m in zip(d, mark) if not m)).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [1, 4096])
def test_repeats(docs, nothing, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    all_rows = docs.select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in all_rows], removed_by_force([r.text for r in all_rows], 200)))
    got = repeats.remove_repeats(docs, ["doc_id", "t"])
    rows = got.select("doc_id", "n_bytes", "n_removed", F.sha2("rest", 256).alias("h"), "t").collect()
    assert len(rows) == len(all_rows)
    assert all(want[r.doc_id] == (r.n_bytes, r.n_removed, r.h) and r.t == "clash" for r in rows)
    assert repeats.remove_repeats(nothing, ["doc_id"]).count() == 0


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for k, n in ((1, 40), (2, 1), (2, 300), (3, 200), (256, 2000)):
        t = rng.integers(0, k, n)
        b = bytes(t.astype(np.uint8))
        assert suffixes.suffix_array(t, 256).tolist() == sorted(range(n), key=lambda i: b[i:])


def test_unigram():
    r = random.Random(4)
    names = sorted({"".join(r.choice("abé") for _ in range(r.randint(1, 4))) for _ in range(25)} | {"▁", "▁a", "▁ab"})
    scored = [(p, -r.random() * 5, 300 + i) for i, p in enumerate(names)]
    model = unigram.Unigram(scored, range(256))
    known = {p.replace("▁", " ").encode(): s for p, s, _ in scored}

    def best(word):
        at = {0: 0.0}
        for i in range(len(word)):
            if i not in at:
                continue
            step = i + len(word[i:].decode(errors="ignore")[:1].encode())
            edges = [(i + len(p), s) for p, s in known.items() if word.startswith(p, i)]
            if step not in [e for e, _ in edges]:
                edges.append((step, model.unknown))
            for e, s in edges:
                at[e] = max(at.get(e, -math.inf), at[i] + s)
        return at[len(word)]

    for _ in range(200):
        word = (" " + "".join(r.choice("abéxz日") for _ in range(r.randint(0, 8)))).encode()
        assert math.isclose(model.best(word)[1], best(word), abs_tol=1e-9)
    many = [(" " + "".join(r.choice("abéxz日🙂 ▁") for _ in range(r.randint(0, 12)))).encode() for _ in range(300)]
    many += [b"", b" " + b"ab" * unigram.LONG_WORD, "日".encode() * (unigram.LONG_WORD // 3)]
    assert [np.frombuffer(x, np.uint32).tolist() for x in model.best_many(many)] == [model.best(w)[0] for w in many]
    assert model.best_many([]) == []
    for text in ("", " ", "a  b ", "ab é▁x日\x00\n"):
        assert model.decode(model.encode(text)) == text


def test_unigram_on_tables(docs, nothing):
    model = unigram.from_model_file(queries.tokenizer_file("piece_bpe_32k.model"))
    rows = unigram.digest(docs, model).collect()
    assert len(rows) == docs.count() and all(r.exact for r in rows)
    full = {r.doc_id: r for r in unigram.encode_decode(docs, model).collect()}
    for r in docs.collect():
        assert full[r.doc_id].decoded == (r.text or "") and full[r.doc_id].ids == model.encode(r.text or "")
    assert unigram.digest(nothing, model).count() == 0
    assert pa.array([""]).type == pa.string()


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 430)] + [(None, 3), (5, 5)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    i, j = zip(*[e for e in edges if None not in e])
    root = components.hook(np.arange(500), np.array(i), np.array(j))
    assert all(root[n] == c for n, c in got.items()) and len(got) >= 31


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert tuple(out.columns) == p.COLUMNS and 0 < out.count() <= docs.count()
        docs = p.cut(out, name)
    pieces_ = p.STAGES[-1][1](spark, docs, sf)
    assert pieces_.select("doc_id").distinct().count() == docs.count()
    rows = docs.collect()
    assert not pairs_by_force([]) and len({r.doc_id for r in rows}) == len(rows)


def test_pipeline_near_duplicates_by_row(spark):
    import corpus_pipeline as p

    a, b, c, d, e = (prose(60 + i, 80) for i in range(5))
    rows = [
        (None, a, "en", "s", 1), (None, b, None, None, None), (None, a + " end", "en", "s", 1),  # null ids: two texts, and a near copy
        (5, c, "en", "s", 1), (5, d, "en", "s", 1), (5, d, "en", "s", 1),  # an id of two texts, one of them twice
        (9, e, "en", "s", 1), (7, e, None, "s", 1), (None, e, "en", None, 1),  # the smallest id stays
        (1, None, None, None, None), (None, None, None, None, None), (None, "", None, None, 0), (None, None, None, None, None),
    ]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    got = Counter((r.doc_id, r.text) for r in p.near_duplicates(spark, table, "").collect())
    kept_a = (None, a) if (None, a) in got else (None, a + " end")
    assert got == Counter([kept_a, (None, b), (5, c), (5, d), (7, e), (1, None), (None, None), (None, ""), (None, None)])
    assert p.near_duplicates(spark, table.limit(0), "").count() == 0
