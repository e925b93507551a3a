"""Operators against brute force on small fixtures, and on nulls, empty tables, ties and clashing names."""

import re
import zlib
from itertools import combinations
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidemark.llm")

import corpus_pipeline  # noqa: E402
from tidemark.llm import ann, boosting, common, fingerprint, language_id, line_dedup, ngram_join, packing, prefix_join, sampling, token_counts, toxicity, url_filter  # noqa: E402
from tidemark.llm.pieces import Vocabulary, default_model  # noqa: E402

DOCS = "doc_id long, text string"
BASE = " ".join(f"w{i}" for i in range(60))
ODD = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (4, BASE), (5, BASE.replace("w30", "x30")), (6, " \n\t "), (7, "ÄÖ 🙂 ▁ a  b\n\n12"), (8, "To " * 20 + "of " * 20 + "to " * 20), (9, "x" * 5000), (None, BASE)]


def docs_of(spark, rows=ODD):
    return spark.createDataFrame(rows, DOCS)


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_rows(n=120, seed=3):
    rng = np.random.default_rng(seed)
    words = [f"v{i}" for i in range(400)]
    out = []
    for g in range(n // 6):
        base = list(rng.choice(words, 80))
        for c in range(6):
            t = list(base)
            for k in rng.choice(80, c * 2, replace=False):
                t[k] = str(rng.choice(words))
            out.append((len(out) * 3 + 1, " ".join(t)))
    return out


def test_components_equal_brute_force(spark):
    rows = near_rows() + [(i + 10_000 if i else 9_999, t) for i, t in ODD if t != BASE]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark, docs_of(spark, rows)).collect()}
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {(i, len(s), find(i)) for i, s in sets.items()}


def test_links_equal_brute_force(spark):
    rows = near_rows() + [(9_000, near_rows()[0][1]), (9_001, "one two"), (9_002, None)]
    sets = {i: shingle_set(t) for i, t in rows}
    least = {}
    for i in sorted(sets):
        least.setdefault(frozenset(sets[i]), i)
    want = {(a, b) for a, b in combinations(sorted(least.values()), 2) if (n := len(sets[a] & sets[b])) and 100 * n >= 75 * len(sets[a] | sets[b])}
    got = [(min(r.a_doc, r.b_doc), max(r.a_doc, r.b_doc)) for r in ngram_join.jaccard_links(spark, docs_of(spark, rows)).collect()]
    root = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark, docs_of(spark, rows)).collect()}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > len(sets) - 2 - len(set(root.values()))  # more than a star a component


def test_one_of_each_group_with_repeated_and_null_ids(spark):
    near, other = BASE.replace("w30", "x30"), " ".join(f"z{i}" for i in range(30))
    lone, nulls = " ".join(f"q{i}" for i in range(30)), " ".join(f"n{i}" for i in range(30))
    rows = [(1, BASE, "b"), (1, BASE, "a"), (2, near, "a"), (None, BASE, "a"), (2, lone, "a"), (5, other, "a"), (4, other, "a"), (None, nulls, "a"), (None, nulls, "a"), (None, "alone here", "a"), (7, "", "a"), (7, "", "a")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((tuple(r) for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()), key=str)
    want = [(1, BASE, "a"), (2, lone, "a"), (4, other, "a"), (None, nulls, "a"), (None, "alone here", "a"), (7, "", "a"), (7, "", "a")]
    assert got == sorted(((i, t, "en", s, len(t)) for i, t, s in want), key=str)


def test_components_of_odd_rows(spark):
    got = [tuple(r) for r in ngram_join.jaccard_components(spark, docs_of(spark)).collect()]
    assert len(got) == len(ODD) and (1, 0, 1) in got and (6, 0, 6) in got and (None, 56, 4) in got and got.count((3, 1, 3)) == 2
    assert ngram_join.jaccard_components(spark, docs_of(spark, [])).count() == 0


def test_lines(spark):
    a, b = "the quick brown fox jumps over that lazy dog", "the quick brown fox jumped over that lazy dog"
    rows = [(2, f"{a}\nshort line\n{a}"), (1, f"zero one two three four five\n{b}"), (3, None), (4, "short line\n"), (5, f"{a} here\nnew words that nobody else has used")]
    df = docs_of(spark, rows).withColumn("line", F.lit("x")).withColumn("row", F.lit(1))
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark, df).collect()}
    assert got[2].removed_lines == [0, 2] or sorted(got[2].removed_lines) == [0, 2]
    assert got[2].text == "short line" and got[1].removed_lines is None and got[3].text is None and got[4].text == "short line\n"
    assert got[5].text == "new words that nobody else has used" and got[5].line == "x" and got[5].row == 1
    assert line_dedup.dedup_lines(spark, docs_of(spark, [])).count() == 0


def test_lines_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    lines = [" ".join(rng.choice([f"u{i}" for i in range(14)], rng.integers(4, 12))) for _ in range(160)]
    rows = [(i, "\n".join(lines[4 * i : 4 * i + 4])) for i in range(40)]
    seen, cut = [], {}
    for i, t in rows:
        for k, line in enumerate(t.split("\n")):
            w = frozenset(line.split())
            if len(w) < line_dedup.LEAST_WORDS:
                continue
            if any(100 * len(w & v) >= line_dedup.PERCENT * len(w | v) for v in seen):
                cut.setdefault(i, set()).add(k)
            seen.append(w)
    got = {r.doc_id: set(r.removed_lines) for r in line_dedup.dedup_lines(spark, docs_of(spark, rows)).collect() if r.removed_lines}
    assert got == cut


def test_short_lines_equal_brute_force(spark):
    """Every line with a word takes part in the query and in the pipeline's stage."""
    rng = np.random.default_rng(8)
    lines = [" ".join(rng.choice([f"u{i}" for i in range(9)], rng.integers(0, 8))) for _ in range(240)] + ["漢字かな交じり文", "a b c d", "d c b a", "a b c d e", "漢字かな交じり文", "", ""]
    rows = [(i, "\n".join(lines[4 * i : 4 * i + 4])) for i in range(62)]
    seen, cut = [], {}
    for i, t in rows:
        for k, line in enumerate(t.split("\n")):
            w = frozenset(line.split())
            if w and any(100 * len(w & v) >= line_dedup.PERCENT * len(w | v) for v in seen):
                cut.setdefault(i, set()).add(k)
            seen.append(w)
    df = docs_of(spark, rows)
    got = {r.doc_id: set(r.removed_lines) for r in line_dedup.dedup_lines(spark, df, least_words=line_dedup.ALL_LINES).collect() if r.removed_lines}
    assert got == cut and len({len(lines[4 * i + k].split()) for i in cut for k in cut[i]} & {1, 2, 3, 4}) == 4
    full = df.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    left = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut.get(i, ())) for i, t in rows}
    assert {r.doc_id: r.text for r in corpus_pipeline.without_repeated_lines(spark, full, "").collect()} == left


def test_languages(spark):
    rng = np.random.default_rng(1)
    make = lambda letters, n: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(n))
    train = spark.createDataFrame([(make(s, 60), k) for k, s in (("aa", "abcde"), ("bb", "vwxyzü")) for _ in range(12)] + [("no label", None)], "text string, lang string")
    model = language_id.learn(train)
    assert model[0] == ["aa", "bb"]
    rows = [(1, make("abcde", 40)), (2, make("vwxyzü", 40)), (3, make("abcde", 60) + " " + make("vwxyzü", 30)), (4, None), (5, "12 !?"), (6, "")]
    got = {r.doc_id: r for r in language_id.predict(spark, docs_of(spark, rows), model).collect()}
    assert (got[1].lang_pred, got[2].lang_pred, got[3].lang_pred) == ("aa", "bb", "aa") and all(got[i].lang_pred == "und" and got[i].score == 0 for i in (4, 5, 6))
    assert got[1].score == 1 and abs(got[3].score - 2 / 3) < 0.1
    none = language_id.learn(train.filter("lang = 'zz'"))
    assert [r.lang_pred for r in language_id.predict(spark, docs_of(spark, rows), none).collect()] == ["und"] * 6
    assert language_id.predict(spark, docs_of(spark, []), model).count() == 0


def test_language_sample_is_of_different_texts(spark):
    texts = [f"{'abcde'[i % 5]}{'vwxyz'[i // 5 % 5]}{'klmno'[i // 25 % 5]} unlike{i}" for i in range(300)]
    once = spark.createDataFrame([(t, "aa") for t in texts], "text string, lang string")
    copied = spark.createDataFrame([(t, "aa") for t in texts + texts[:2] * 400], "text string, lang string")
    for sample in (60, 1_000):  # copies change neither which texts are chosen nor their weight
        (langs, a), (_, b) = (language_id.learn(df, sample=sample) for df in (once, copied))
        assert langs == ["aa"] and np.array_equal(a, b) and len(np.unique(a)) > 1


def test_corpus_without_labels_keeps_texts_with_a_letter(spark):
    docs = spark.createDataFrame([(i, t, None, "s", None) for i, t in ODD] + [(50, "12 !?", None, "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.in_some_language(spark, docs, "")
    assert got.columns == corpus_pipeline.COLUMNS
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(((i, t) for i, t in ODD if t and t.strip()), key=str)


def test_boosting_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) & (x[:, 2] < 0.5)).astype(float)
    m = boosting.fit_trees(x[:2000], y[:2000], rounds=40)
    k = boosting.fit_isotonic(boosting.margins(m, x[2000:2500]), y[2000:2500])
    p = boosting.calibrated(k, boosting.margins(m, x[2500:]))
    assert ((p >= 0.5) == (y[2500:] > 0)).mean() > 0.97 and p.min() >= 0 and p.max() <= 1
    assert (np.diff(boosting.calibrated(k, np.linspace(-9, 9, 200))) >= 0).all()


def test_toxicity(spark):
    rng = np.random.default_rng(2)
    words = ["river", "stone", "cloud", "green", "walks", "under", "seven", "bright"]
    rows = [(i, " ".join(rng.choice(words, 40)) + (" you grubnik fool" * 2 if i % 4 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(7, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.rate(spark, docs_of(spark, rows + [(1000, None), (1001, "")]), labels)
    r = {x.doc_id: x for x in got.collect()}
    held = [i for i in range(400) if r[i].held_out]
    assert held == [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([r[i].predicted == (i % 4 == 0) for i in held]) > 0.95 and r[1000].predicted == r[1001].predicted == 0
    assert toxicity.rate(spark, docs_of(spark, rows[:3]), labels.filter("doc_id < 0")).agg(F.max("score")).first()[0] == 0


def test_second_person_words_near_any_hit():
    features, near = toxicity.Features([]), toxicity.NAMES.index("second_near")
    few, many = (features("idiot x " * n + "you idiot")[near : near + 2] for n in (300, 200_010))
    # before the word, hits end 4, 12, 20, 28 and 36 characters from its start; the one after it, 8
    assert few == [6 / 301, 1 / 5] and many == [6 / 200_011, 1 / 5]
    rng = np.random.default_rng(7)
    for _ in range(40):
        text = " ".join(rng.choice(["idiot", "you", "bayou", "yourself", "river", "trash", "xyzzyxyzzy"], 50))
        starts = [m.start() for m in toxicity.SECOND.finditer(text)]
        gaps = [min((abs(s - e) for s in starts if e - toxicity.NEAR <= s < e + toxicity.NEAR), default=None) for e, _, _ in features.hits(text)]
        close = [g for g in gaps if g is not None]
        assert features(text)[near : near + 2] == [len(close) / max(1, len(gaps)), 1 / (1 + min(close)) if close else 0.0]


def test_fingerprints(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "".join(rng.choice(list("abcdefgh ijklm\n"), rng.integers(0, 900)))) for i in range(60)] + [(100, None), (101, "é" * 41), (102, "same text"), (103, "same text")]
    rows = [(i if i else None, t) for i, t in rows]
    df = docs_of(spark, rows)
    got = {r.doc_id: r for r in fingerprint.fingerprints(spark, df).collect()}
    order = [t or "" for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]
    ids = [i for i, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]
    import hashlib

    for k, i in enumerate(ids):
        t, nxt = order[k], order[(k + 1) % len(order)]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), i
        a, b = fingerprint.read(got[i].fingerprint), fingerprint.read(got[i].edited_fingerprint)
        assert abs(fingerprint.likeness(a, b) - got[i].near_edited) < 1e-12
        assert abs(fingerprint.likeness(a, fingerprint.read(got[ids[(k + 1) % len(ids)]].fingerprint)) - got[i].near_next) < 1e-12
    assert got[102].fingerprint == got[103].fingerprint and got[102].near_next == 1 and got[100].fingerprint == ""
    small = {(r.doc_id, r.edited_sha256) for r in fingerprint.with_next(df, per_range=5).groupBy("range").count().select(F.col("range").alias("doc_id"), F.lit("").alias("edited_sha256")).collect()}
    assert len(small) > 5
    assert fingerprint.fingerprints(spark, docs_of(spark, [])).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(900, 12))
    v[300:600] = v[300]  # a third are one vector
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(2000, None), (2100, [0.0] * 12), (2200, [float("nan")] * 12), (2300, [1.0]), (None, [1.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(spark, df, F.col("vec_id") % 100 == 0).collect()
    hits = 0
    for q in range(0, 900, 100):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        true = [j for j in np.lexsort((np.arange(900), d)) if j != q][:10]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11)) and all(abs(d[r.vec_id] - r.score) < 1e-12 for r in own)
        hits += len({r.vec_id for r in own} & set(true))
    assert hits >= 0.9 * 90 and {r.query_id for r in got} == set(range(0, 900, 100))
    assert ann.search(spark, df.filter("vec_id > 1999"), F.col("vec_id") % 100 == 0).count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    rows = ODD + [(i, "Hello WORLD's " * i) for i in range(20, 900, 37)] + [(5000, "a\x1cb ΣΑΣ İ <|endoftext|> ß 漢字")]
    rows = [(i if i else -1, t) for i, t in rows]
    ids = [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for _, t in rows]
    got = packing.pack(spark, docs_of(spark, rows).repartition(2)).collect()
    want = {}
    for (i, _), x in zip(rows, ids):
        want.setdefault(i, []).append(x)
    total, by = {}, {}
    for r in got:
        x = want[r.doc_id][0]
        assert r.doc_tokens == len(x) and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert total == {i: sum(map(len, xs)) for i, xs in want.items()}
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0
    assert packing.pack(spark, docs_of(spark, [])).count() == 0


def test_level_is_the_least_change():
    rng = np.random.default_rng(9)
    p = packing.Packer(0, 64)
    for _ in range(300):
        r = int(rng.integers(1, 64))
        before = (p.count**2).sum()

        def after(h):
            c = p.count.copy()
            if h:
                c[h] -= 1
            if h + r < 64:
                c[h + r] += 1
            return (c**2).sum() - before

        options = [0] + [h for h in range(1, 64 - r + 1) if p.count[h]]
        assert after(p.level(r)) == min(map(after, options))
        p.add(1, b"\1\0\0\0" * r)


def test_urls(spark):
    import duckdb

    urls = ["https://a.example.net/en/1", "http://net/x", "http://NET/", "http://x.net", "https://example.com/de/9?q#f", "https://badexample.com/de/", "http://k.org/fr/a", "http://k.org/FR/a", None, "no scheme", "://", "http://ads.org/x", "http://h\n.net/a\nb", "http://a.net?x/", "https://www.casino-win.de/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(spark, pages).collect()}
    by_join = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(spark, pages, literal_rules=0).collect()}
    c = duckdb.connect()
    c.execute("create table pages (page_id bigint, url varchar)")
    c.executemany("insert into pages values (?, ?)", [(i, u) for i, u in enumerate(urls)])
    sql = {r[0]: tuple(r[1:]) for r in c.execute(url_filter.sql()).fetchall()}
    assert got == sql == by_join
    assert got[0][2:] == ("example.net/en/", "allow") and got[2][2:] == ("net/", "block") and got[3][2] is None and got[8] == ("", "", None, "allow") and got[11][3] == "block"
    assert url_filter.judge(spark, pages.filter("page_id < 0")).count() == 0


TEXTS = ["", None, "hello world", "a  b\n\n c ▁ x", "한국어 🙂 \t\x00tab", " lead", "the the\nthe", "x" * 300, "\n"]


def test_sampling(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "hello world")]
    got = sampling.sample_pieces(spark, docs_of(spark, rows).repartition(3))
    assert {r.doc_id: r.text for r in got.collect()} == dict(rows)
    assert all(r.lossless for r in sampling.sample_digests(spark, docs_of(spark, rows)).collect())
    one = {r.doc_id: r.ids for r in got.collect()}
    assert one == {r.doc_id: r.ids for r in sampling.sample_pieces(spark, docs_of(spark, rows[::-1])).collect()}
    assert sampling.sample_digests(spark, docs_of(spark, [])).count() == 0


def test_sampled_shares():
    lattices = sampling.Lattices(default_model())
    v = lattices.vocabulary
    number = {v.pieces[i]: i for i in v.score}
    share: dict[tuple, float] = {}

    def walk(rest, ids, weight):
        if not rest:
            share[ids] = weight
        for k in range(1, len(rest) + 1):
            if rest[:k] in number:
                walk(rest[k:], (*ids, number[rest[:k]]), weight * lattices.weight[number[rest[:k]]])

    walk("▁then", (), 1.0)
    n, total, seen = 20_000, sum(share.values()), {}
    for x in lattices.encode([(7919 * k, "then") for k in range(n)]):
        seen[tuple(x.tolist())] = seen.get(tuple(x.tolist()), 0) + 1
    assert set(seen) <= set(share) and max(abs(seen.get(k, 0) / n - w / total) for k, w in share.items()) < 0.015


def test_token_counts(spark):
    from tokenizers import Tokenizer, models

    v = Vocabulary(default_model())
    scored = [(v.pieces[i], v.score[i]) if i in v.score else (f"\x02{i}", -1.0) for i in range(len(v.pieces))]
    unigram = Tokenizer(models.Unigram(scored, 0, False))
    rows = [(i, t) for i, t in enumerate(TEXTS) if t is None or "▁" not in t] + [(50, "internationalization of thermodynamics"), (51, "aaaaaaaa bbbb  cc")]
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(spark, docs_of(spark, rows)).collect()}
    for i, t in rows:
        s = "▁" + t.replace(" ", "▁") if t else ""
        e = unigram.encode(s)
        assert got[i] == sum(len(s[a:b].encode()) if k == 0 else 1 for k, (a, b) in zip(e.ids, e.offsets)), t
    assert token_counts.count_tokens(spark, docs_of(spark, [])).count() == 0


def test_posting_lists_do_not_depend_on_batches():
    rng = np.random.default_rng(11)
    token = np.sort(rng.integers(0, 40, 900))
    token[300:] = 7_000  # one long list
    words = [rng.choice(60, 20, replace=False) for _ in token]
    words = [words[i] if i % 3 else np.where(words[i - 1] == words[i - 1][0], 99, words[i - 1]) for i in range(len(words))]
    _, h, _, _, sizes = line_dedup.line_words([" ".join(f"w{k}" for k in w).encode() for w in words])
    m1, m2 = line_dedup.parities(h, sizes)
    doc = np.arange(900) // 2
    meta = (sizes << 30) | rng.integers(1, 5, 900)
    names = ["token", "sid", "meta", "m1", "m2", "doc"]
    whole = pa.RecordBatch.from_pydict(dict(zip(names, map(pa.array, (token, np.arange(900), meta, m1, m2, doc)))))

    def fits(i, j):
        (na, p), (nb, q) = ((int(meta[k]) >> 30, int(meta[k]) & ((1 << 30) - 1)) for k in (i, j))
        differ = sum(bin((int(m[i]) ^ int(m[j])) & (2**64 - 1)).count("1") for m in (m1, m2))
        return 100 * min(na, nb) >= 80 * max(na, nb) and 180 * (min(p, q) + min(na - p, nb - q)) >= 80 * (na + nb) and 180 * differ <= 20 * (na + nb)

    want = {p for i in range(900) for j in range(i) if token[i] == token[j] and fits(i, j) for p in ([(i, j), (j, i)] if doc[i] == doc[j] else [(i, j)])}
    assert len(want) > 200
    for size in (1, 7, 100, 900):
        parts = [whole.slice(i, size) for i in range(0, 900, size)]
        out = [tuple(r.values()) for b in line_dedup._found(80, keep=10_000)(iter(parts)) for r in b.to_pylist()]
        assert sorted((r[0], r[1]) for r in out) == sorted(want) and not any(r[3] for r in out), size
        short = [r for b in line_dedup._found(80, list_rows=50, near=8, keep=1)(iter(parts)) for r in b.to_pylist()]
        assert {(r["sid"], r["lead"]) for r in short if r["lead"] is not None} <= want
        assert {r["sid"] for r in short if r["more"]} >= {i for i, _ in want} - {r["sid"] for r in short} | {i for i in range(400, 900)}


def test_parity_maps_bound_the_difference():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 60, 30)).encode() for _ in range(40)]
    _, h, at, _, sizes = line_dedup.line_words(texts)
    sets = [set(h[a : a + k].tolist()) for a, k in zip(at, sizes)]
    m1, m2 = (m.view(np.uint64) for m in line_dedup.parities(h, sizes))
    for i in range(40):
        for j in range(i):
            assert int(np.bitwise_count(m1[i] ^ m1[j])) + int(np.bitwise_count(m2[i] ^ m2[j])) <= len(sets[i] ^ sets[j])


def test_filling_moves_few_ids():
    """Most ids stay in the sequence that the sum of squares chose; nothing is padded, open sequences are bounded."""
    rng = np.random.default_rng(12)
    for n, most in ((250, 0.2), (3_000, 0.1)):
        p = packing.Packer(0)
        sizes = np.minimum(rng.lognormal(5.3, 1.3, n).astype(int) + 1, 30_000).tolist()
        for i, size in enumerate(sizes):
            p.add(i, b"\1\0\0\0" * size)
            assert p.opened == p.count.sum() == sum(map(len, p.open.values()))
        p.finish()
        lengths, got = {}, {}
        for doc, start, length, _, total, seq, offset in p.rows:
            assert offset == lengths.get(seq, 0) and total == sizes[doc]
            lengths[seq] = offset + length
            got.setdefault(doc, []).append((start, length))
        assert p.moved / sum(sizes) < most and all(x == 2048 or x & (x - 1) == 0 for x in lengths.values())
        assert sorted(x for x in lengths.values() if x < 2048) == sorted(set(x for x in lengths.values() if x < 2048))  # at most one of each power of two
        for doc, pieces in got.items():
            at = 0
            for start, length in sorted(pieces):
                assert start == at
                at += length
            assert at == sizes[doc]


def test_open_sequences_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "MOST_OPEN", 5)
    rng = np.random.default_rng(13)
    p, total = packing.Packer(0, 64), 0
    for i in range(400):
        size = int(rng.integers(30, 64))
        total += size
        p.add(i, b"\1\0\0\0" * size)
        assert p.opened <= 5 and p.opened == p.count.sum()
    p.finish()
    assert sum(r[2] for r in p.rows) == total


def test_numbers_and_marks_are_no_letters(spark):
    train = spark.createDataFrame([("some words of one language", "aa")] * 3, "text string, lang string")
    model = language_id.learn(train)
    rows = [(1, "½ ²"), (2, "①⑳ Ⅷ"), (3, "2nd"), (4, "́ ̈"), (5, "漢字"), (6, "ª")]
    docs = docs_of(spark, rows).withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit("clash"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(spark, docs, model).collect()}
    assert got[1] == got[2] == got[4] == ("und", 0.0) and got[3][0] == got[5][0] == got[6][0] == "aa"


def test_mixture_equals_plain_em():
    """Rounds of EM and the penalty of the language set, recomputed word by word."""
    import math

    rng = np.random.default_rng(21)
    k, shares = 3, []
    like = []
    doc = []
    for d, theta in enumerate(([1, 0, 0], [0.6, 0.4, 0], [0.34, 0.33, 0.33], [0.97, 0.03, 0])):
        for _ in range(60):
            own = int(rng.choice(k, p=theta))
            row = rng.normal(-30, 1, k)
            row[own] += rng.uniform(3, 9)
            like.append(row)
            doc.append(d)
    like, doc = np.array(like), np.array(doc)
    got = language_id.mixtures(like.astype(np.float32), doc, 4)

    def em(rows, langs):
        theta = [1 / len(langs)] * len(langs)
        for _ in range(400):
            total = [0.0] * len(langs)
            for r in rows:
                w = [t * math.exp(r[i] - max(r)) for t, i in zip(theta, langs)]
                for j, x in enumerate(w):
                    total[j] += x / sum(w)
            theta = [t / len(rows) for t in total]
        fit = sum(max(r) + math.log(sum(t * math.exp(r[i] - max(r)) for t, i in zip(theta, langs))) for r in rows)
        return theta, fit

    for d in range(4):
        rows = like[doc == d].tolist()
        full, _ = em(rows, [0, 1, 2])
        order = sorted(range(k), key=lambda i: -full[i])
        chosen, (theta, fit) = order[:1], em(rows, order[:1])
        for size in (2, 3):
            t, f = em(rows, order[:size])
            if f - 0.5 * (size - 1) * math.log(len(rows)) <= fit - 0.5 * (size - 2) * math.log(len(rows)):
                break
            chosen, theta, fit = order[:size], t, f
        want = np.zeros(k)
        want[chosen] = theta
        shares.append(len(chosen))
        assert np.abs(got[d] - want).max() < 0.05, d
    assert len(set(shares)) > 1


def plain_digest(text: bytes, rank, windows=32, reach=32, bits=2048, each=5, features=160):
    """Filters of one text by the docstring: each window's entropy, rarity, the least of its neighbourhood, chained Bloom bits."""
    import hashlib
    import math
    from collections import Counter

    m = (1 << 64) - 1

    def window_hash(w):
        h = [(c + 1) * 0x9E3779B97F4A7C15 & m for c in w]
        size = 1
        while size < windows:
            h = [(h[i] * 0xD6E8FEB86659FD93 + (h[i + size] ^ (h[i + size] >> 29))) & m for i in range(len(h) - size)]
            size *= 2
        x = h[0] ^ (h[0] >> 32)
        x = x * 0xBF58476D1CE4E5B9 & m
        return x ^ (x >> 31)

    keys, hashes = [], []
    for i in range(len(text) - windows + 1):
        w = text[i : i + windows]
        entropy = -sum(c / windows * math.log2(c / windows) for c in Counter(w).values()) / math.log2(windows)
        level = min(255, max(0, int(entropy * 256 + 1e-7)))
        hashes.append(window_hash(w))
        keys.append((int(rank[level]) << 24) | (hashes[-1] >> 40))
    picked = []
    for i, key in enumerate(keys):
        if key == min(keys[max(0, i - reach) : i + reach + 1]) and hashes[i] not in picked:
            picked.append(hashes[i])
    if not picked and text:
        picked = [int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")]
    out = []
    for k in range(0, len(picked), features):
        on = {(h >> 11 * j) & (bits - 1) for h in picked[k : k + features] for j in range(each)}
        out.append((on, len(picked[k : k + features])))
    return out


def test_digests_equal_plain_ones():
    rng = np.random.default_rng(31)
    texts = [b"", b"short", bytes(rng.integers(97, 105, 32).astype(np.uint8)), bytes(rng.integers(97, 122, 900).astype(np.uint8)), b"aaaa bbbb " * 60, bytes(rng.integers(0, 256, 9000).astype(np.uint8))]
    rank = rng.permutation(256).astype(np.uint32)
    rank[:] = np.argsort(np.argsort(np.abs(np.arange(256) - 200)))
    for t, filters in zip(texts, fingerprint.digests(texts, rank)):
        want = plain_digest(t, rank)
        assert [(set(np.flatnonzero(np.unpackbits(b)).tolist()), n) for b, n in filters] == want, t[:20]


def test_ranges_change_no_fingerprint(spark, monkeypatch):
    rng = np.random.default_rng(32)
    rows = [(int(i), " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"], int(rng.integers(0, 60))))) for i in range(80)] + [(None, "null id"), (7, "repeated id")]
    whole = sorted(map(tuple, fingerprint.fingerprints(spark, docs_of(spark, rows)).collect()), key=str)
    plain = fingerprint.with_next
    monkeypatch.setattr(fingerprint, "with_next", lambda docs: plain(docs, per_range=9))
    assert sorted(map(tuple, fingerprint.fingerprints(spark, docs_of(spark, rows)).collect()), key=str) == whole


def test_ranges_of_many_bounds(spark):
    """As many bounds as there can be: each id is in the range that counting tells, and bounds are known as such."""
    bounds = [7 * i - 1000 for i in range(1, fingerprint.MOST_RANGES)]
    ids = [None, -(1 << 62), -993, -994, -992, 0, bounds[255], bounds[256] - 1, bounds[511], bounds[-1], bounds[-1] + 1, 1 << 62]
    for some in ([], bounds[:1], bounds[:5], bounds):
        at, is_bound = fingerprint._placed(some, "bigint")
        for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", at.alias("at"), is_bound.alias("is_bound")).collect():
            assert (r["at"], r.is_bound) == ((0, False) if r.doc_id is None else (int(np.searchsorted(some, r.doc_id, side="right")), r.doc_id in some))


def test_recall_where_the_tree_knows_a_part(spark):
    """fit_rows far below the rows; leaves are split, and every row is indexed."""
    rng = np.random.default_rng(41)
    centres = rng.normal(size=(30, 8)) * 3
    v = centres[rng.integers(0, 30, 4000)] + rng.normal(size=(4000, 8))
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(spark, df, F.col("vec_id") % 100 == 0, fit_rows=400).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 4000, 100):
        d = ((v - v[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.9 * 400 and all(len(x) == 10 for x in got.values())


def test_split_leaves_and_queries_change_no_neighbour(spark, monkeypatch):
    rng = np.random.default_rng(43)
    v = rng.normal(size=(900, 4))
    v[:300] = v[0]  # a third of all rows are one vector, and ask
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    run = lambda: sorted(map(tuple, ann.search(spark, df, F.col("vec_id") % 5 == 0, fit_rows=300).collect()))
    whole = run()
    monkeypatch.setattr(ann, "PART_ROWS", 20)
    monkeypatch.setattr(ann, "PART_QUERIES", 7)
    assert run() == whole and len(whole) == 180 * 10


def test_rules_without_a_literal_run_on_every_url(spark):
    rule = url_filter.Rule("digits", "block", "^[0-9.]+(/|$)", (), False)
    pages = spark.createDataFrame([(1, "http://1.2.3.4/x"), (2, "http://a.org/1"), (3, None)], "page_id long, url string")
    for most in (100, 0):
        assert {r.page_id: r.verdict for r in url_filter.judge(spark, pages, url_filter.RULES + (rule,), literal_rules=most).collect()} == {1: "block", 2: "allow", 3: "allow"}


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score double"


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, repeats, ties and a clashing column through all stages, and an empty table."""
    words = [f"w{i}" for i in range(400)]
    rng = np.random.default_rng(51)
    make = lambda n: " ".join(rng.choice(words, n))
    base = make(80)
    rows = [(i, make(60), "aa", "s", 1, 0.5) for i in range(60)] + [(100, base, "aa", None, None, None), (101, base, None, "s", 1, 0.1), (102, base.replace(base.split()[40], "zz", 1), "aa", "s", 1, 0.1), (103, None, "aa", "s", None, None), (None, make(30), "aa", "s", 1, 0.2), (104, "", None, None, 0, None), (105, "½ ²", None, None, 0, None)]
    for name, own in (("full", rows), ("empty", [])):
        d = tmp_path / name
        spark.createDataFrame(own, DOCUMENTS).write.parquet(str(d / "documents.parquet"))
        spark.createDataFrame([(i, 0) for i in range(60)] if own else [], "doc_id long, toxic int").write.parquet(str(d / "labels.parquet"))
        got = corpus_pipeline.run(spark, str(d)).collect()
        # line dedup has taken the only line of 101 and 102: they stay, empty, with the end token alone
        assert {r.doc_id for r in got} == ({*range(60), 100, 101, 102, None} if own else set())
        assert {r.doc_id for r in got if r.doc_tokens == 1} == ({101, 102} if own else set())


def test_pipeline_from_another_folder(tmp_path):
    """Workers get the package from the session, not from their working directory."""
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(corpus_pipeline.__file__).resolve().parent
    code = f"""
import sys
sys.path.insert(0, {str(repo)!r})
from pyspark.sql import SparkSession
import corpus_pipeline
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
d = s.createDataFrame([(i, "some words here " + str(i), "aa", "s", 1) for i in range(5)], "doc_id long, text string, lang string, source string, n_chars long")
print("ROWS", corpus_pipeline.in_some_language(s, d, "").count())
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "ROWS 5" in done.stdout, done.stderr[-2000:]


def test_words_are_sorted_by_line_level_and_hash(monkeypatch):
    rng = np.random.default_rng(2)
    line = np.sort(rng.integers(5, 60, 4000))
    h = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    h[::7] = h[0]
    h[1::7] = h[0] ^ rng.integers(0, 8, len(h[1::7]), dtype=np.uint64)  # alike in all bits that a key has
    rank = (h % np.uint64(5)).astype(np.uint8)
    for h, rank in ((h, rank), (h | np.uint64(1 << 63), rank), (rng.integers(0, 1 << 63, 4000, dtype=np.uint64), rank)):
        for level in (None, rank):
            plain = np.lexsort((h, line) if level is None else (h, level, line))
            for at in (line, line * (1 << 20)):  # the latter: more lines than a key has
                got = line_dedup.in_order(at, h, level)
                assert (line[got] == line).all() and (h[got] == h[plain]).all()
    sorts, real = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sorts.append(len(keys)) or real(keys))
    table = type("Table", (), {"value": np.full(1 << 16, 100, dtype=np.uint8)})
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array([" ".join(f"w{i}" for i in range(5000)) + "\na b\nb a"])], names=["row", "doc_id", "text"])
    (got,) = line_dedup._index(table, 80, 1)(iter([batch]))
    sid, prefix = got.column(3).to_pylist(), got.column(6).to_pylist()
    assert not sorts  # one sort of plain keys is all that words of a corpus need
    assert sid[1] == sid[2] != sid[0] and len(prefix[0]) == 1001 and np.all(np.diff(np.array(prefix[0]).view(np.uint64)) > 0)


def test_range_of_ids_changes_no_line(spark):
    rng = np.random.default_rng(8)
    lines = [" ".join(f"w{k}" for k in rng.integers(0, 60, 12)) for _ in range(60)]
    rows = []
    for i in range(80):
        text = "\n".join(lines[k] + ("" if rng.random() < 0.5 else f" x{rng.integers(0, 9)}") for k in rng.integers(0, 60, 6))
        rows.append((i if i else None, text))
    found = []
    for wide in (1, 10**12):  # in one number with the word, and beside it
        docs = docs_of(spark, [(i if i is None else i * wide - 40 * wide, t) for i, t in rows])
        found.append({(-41 if r.doc_id is None else r.doc_id // wide, tuple(sorted(r.removed_lines or ()))) for r in line_dedup.dedup_lines(spark, docs).collect()})
    assert found[0] == found[1] and sum(len(x[1]) for x in found[0]) > 100
    names = docs_of(spark, [(None, "a b c d e")] + [(i, "a b c d e") for i in (5, -7)]).selectExpr("cast(doc_id as string) as doc_id", "text")
    assert {r.doc_id: r.removed_lines for r in line_dedup.dedup_lines(spark, names).collect()} == {None: None, "5": [0], "-7": [0]}


def test_counts_saturate_as_they_are_given_out():
    counts = prefix_join.Counts(16)
    for n in (3, 70_000, 70_000):
        counts.add(np.full(n, 9 + (1 << 16), dtype=np.uint64))
    counts.add(np.array([4, 4, 4 + (1 << 20)], dtype=np.uint64))
    (chunk,) = counts.batches()
    data = chunk.column(3)[0].as_py()
    assert chunk.column(1)[0].as_py() == 2 and np.frombuffer(data, dtype=np.uint16).tolist() == [4, 9, 3, 65_535]


def test_workers_keep_the_words_of_one_operator():
    path = packing.default_tokenizer()
    assert packing.word_ids(path) is packing.word_ids(path)
    kept = packing.word_ids(path)
    assert list(common.light(lambda it: (x + 1 for x in it), packing.OWNER)([1, 2])) == [2, 3]
    assert packing.word_ids(path) is kept
    assert list(common.light(iter)([1])) == [1]
    assert not common.remembered and packing.word_ids(path) is not kept


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="no memory figures")
def test_tasks_give_memory_back():
    def held():
        return sum(map(int, re.findall(r"\nPrivate_Dirty:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) >> 10

    def run(it):
        for _ in it:
            small = [bytes(2000) for _ in range(60_000)]
            yield len(small)
            last.append(small[-1])  # what is freed lies below what stays

    last: list = []
    before = held()
    assert list(common.light(run)([0])) == [60_000]
    assert held() - before < 40  # 120 MB were held, and a plain task leaves them with the allocator


def test_scratch_writes_no_checksum_files(spark, tmp_path):
    scratch = common.Scratch(spark, "plain")
    scratch.base = f"file://{tmp_path}/plain"
    assert scratch.write(spark.range(100).repartition(5), "t").count() == 100
    assert len(list((tmp_path / "plain/t").glob("part-*"))) == 5 and not list((tmp_path / "plain/t").glob(".*.crc"))
