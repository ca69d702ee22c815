"""Corpus operators against brute force on a small table with odd rows: nulls in
any column, empty and long texts, repeated rows, clashing extra columns."""
import hashlib
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import (licenses, linededup, mixing, ngramjoin, packing, permutation, quality, records, secrets,
                         substrings)
from quillon.llm.components import components
from quillon.llm.tokens import Encoder, vocabulary_path

WORD = re.compile("[^ \t-\r]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, row string, h int, `uid` long"
BASE = " ".join(f"wörd{i} and" for i in range(120))
TEXTS = [
    (1, BASE, "a"), (2, BASE, "a"), (3, BASE.replace("wörd7 ", "other "), "a"), (4, "", "b"), (5, None, "b"), (None, "null id here", None),
    (6, "Short line\nShort line\n\nunder the MIT license", "c"), (6, "Short line\nShort line\n\nunder the MIT license", "c"),
    (7, "user=bob\npassword='hunter22hunter'\npwd=abcd\nhttps://a.example/x\n\n\n\npwd=zzzz AKIAABCDEFGHIJKLMN " + "ab12" * 10, "c"),
    (8, "x" * 450 + " " + BASE[:300], "a"), (9, "one two three", "d"), (10, "ONE two three", "d"), (11, "z" * 199, "d"), (12, "z" * 199, "d"),
    (13, "\n".join(f"the quick brown fox number {i % 7} jumps over the lazy dog" for i in range(400)), "a"), (14, " \t\n ", "a"),
    (15, "secret: api_key = \"abcdefgh\" token=" + "q" * 9, "e"), (16, "<|endoftext|> a\x1cb c d", "e"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", s, len(t or ""), 5, "r", 1, 2) for i, t, s in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def components_of(sets, percent):
    root = list(range(len(sets)))

    def find(x):
        return x if root[x] == x else find(root[x])
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


def test_secrets(docs, empty):
    rows = secrets.secret_report(docs).collect()
    either = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    assign = re.compile("(" + "|".join(map(either, ["password", "passwd", "secret", "token", "api_?key"])) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")

    def base(t):
        out = [("assign", *m.span()) for m in assign.finditer(t) if len(m[2]) >= 8]
        out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        out.sort(key=lambda x: (x[1], secrets.KINDS.index(x[0])))
        n = Counter(k for k, *_ in out)
        return n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in out).encode()).hexdigest()
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows) == Counter((i, *base(t or "")) for i, t, _ in TEXTS)
    spans = next(r.spans for r in rows if r.doc_id == 7)
    assert "ident:0:8" in spans and "weak:" in spans and "endpoint:" in spans
    lone = next(r for r in rows if r.doc_id == 15)
    assert lone.n_weak == 0 and lone.n_ident == 0
    assert secrets.secret_report(empty).count() == 0


def test_substrings(docs, empty):
    n, texts, count = 200, [(i, (t or "").encode()) for i, t, _ in TEXTS], Counter()
    for _, t in texts:
        count.update(t[k:k + n] for k in range(len(t) - n + 1))

    def cut(t):
        gone = np.zeros(len(t), dtype=bool)
        for k in range(len(t) - n + 1):
            if count[t[k:k + n]] > 1:
                gone[k:k + n] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        return len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()
    want = Counter((i, *cut(t)) for i, t in texts)
    for hot in (50_000, 1):
        assert Counter(map(tuple, substrings.repeated_substrings(docs, hot=hot).collect())) == want
    assert substrings.repeated_substrings(empty).count() == 0


def test_samples_of_pieces_agree():
    text = np.random.default_rng(1).integers(97, 120, substrings.BLOCK_BYTES * 2 + 777).astype(np.uint8).tobytes()
    at, _ = substrings.samples([text])[0]
    half = len(text) // 2
    part, _ = substrings.samples([text[half:]])[0]
    inner = {p for p in at.tolist() if half + 200 <= p <= len(text) - 400}
    assert inner == {p + half for p in part.tolist() if 200 <= p <= len(text) - half - 400}


def test_quality(docs, empty):
    model = {"weights": [[0.0] * quality.FEATURES] * 2, "trans": [[0.0, 0.0], [0.0, 0.0]]}
    rows = quality.rated(docs, model).collect()

    def base(t):
        words, seen, dup = WORD.findall(t), set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        grams = list(zip(words, words[1:], words[2:]))
        n = Counter(grams)
        rep = len({k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(3)})
        failed = len(words) < 50 or 100 * rep > 50 * len(words)
        return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, rep, failed, not failed
    assert Counter(tuple(r)[:8] for r in rows) == Counter((i, *base(t or "")) for i, t, _ in TEXTS)
    assert quality.rated(empty, model).count() == 0
    assert quality.train(empty, empty.selectExpr("doc_id", "size as quality")) == model


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7):
        s, t = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        paths = [[k >> j & 1 for j in range(n)] for k in range(2 ** n)]
        best = max(paths, key=lambda p: sum(s[i, c] for i, c in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:])))
        assert quality.viterbi(s, t).tolist() == best


def test_training_takes_one_row_of_a_labelled_id(spark):
    good, bad = "A calm line of plain words.\nAnother such line follows it.", "BUY | NOW !!\n$$ 50% OFF | CLICK !!"
    once = [(k, (good if k % 2 else bad) + f"\nline {k}") for k in range(12)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, quality int")
    schema = "doc_id long, text string"
    want = quality.train(spark.createDataFrame(once, schema), labels)
    assert quality.train(spark.createDataFrame(once + [once[3]] * 500, schema), labels) == want
    assert any(v for w in want["weights"] for v in w)


def test_trained_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0
    model = quality.train(docs, labels.filter(half), docs_limit=400)
    r = quality.rated(docs, model).join(labels.filter(~half), "doc_id").filter("not base_failed")
    right, n = r.agg(F.count_if(F.col("kept") == (F.col("quality") == 1)), F.count(F.lit(1))).first()
    assert right / n > 0.97


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_encoding_is_exact(name):
    enc = Encoder(vocabulary_path(name))
    for text in [t or "" for _, t, _ in TEXTS] + ["it's  a\n\n b\t c", " lead", "trail ", "Éa éx ́y"]:
        want = np.array(enc.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert enc.encode(text) == want == enc.encode(text)


def test_records_round_trip(spark, docs, empty, tmp_path):
    path, vocab = str(tmp_path / "records"), vocabulary_path("byte_bpe_50k.json")
    index = records.write_and_index(docs, vocab, path, files=3).collect()
    enc = Encoder(vocab)
    ids = {(i, t): np.append(np.frombuffer(enc.encode(t or ""), "<u4"), 0).astype("<u4") for i, t, _ in TEXTS}
    want = Counter((i, len(ids[i, t]), zlib.crc32(ids[i, t].tobytes())) for i, t, _ in TEXTS)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in index) == want
    at = 0
    for r in sorted(index, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(index, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    shuffled = records.read_shuffled(spark, path, seed=4).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in shuffled) == Counter((i, tuple(ids[i, t].tolist())) for i, t, _ in TEXTS)
    assert records.write_and_index(empty, vocab).count() == 0


def test_damaged_record_is_noticed():
    data = bytearray(records.frame(5, np.arange(9)) + b"\n")
    assert [x[2] for x in records.frames(bytes(data))] == [5]
    data[15] ^= 1
    with pytest.raises((ValueError, struct.error)):
        list(records.frames(bytes(data)))


def test_mixing(docs, empty):
    rows = mixing.fair_mix(docs).collect()
    assert len(rows) == len(TEXTS) and all(r.copies <= 2 for r in rows)
    total = sum(r["size"] for r in rows)
    assert sum(r["copies"] * r["size"] for r in rows) <= 1.5 * total
    per = {r.source: (r.source_size, r.target) for r in rows}
    assert abs(sum(t for _, t in per.values()) - 1.5 * total) < 1e-6 and all(t <= 2 * s + 1e-9 for s, t in per.values())
    assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.fair_mix(docs.repartition(5)).collect()))
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.fair_mix(empty).count() == 0


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80)])
def test_ngram_join(docs, empty, size, percent):
    sets = []
    for _, t, _ in TEXTS:
        w = WORD.findall(lower(t or ""))
        sets.append({tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = components_of(sets, percent)
    ids = [i for i, _, _ in TEXTS]
    first = {r: min((ids[k] for k in range(len(ids)) if root[k] == r and ids[k] is not None), default=None) for r in set(root)}
    want = Counter((ids[k], len(sets[k]), first[root[k]] if sets[k] else ids[k]) for k in range(len(ids)))
    got = ngramjoin.similar_components(docs, size, percent).collect()
    assert Counter(tuple(r)[:3] for r in got) == want
    assert ngramjoin.similar_components(empty).count() == 0
    one = ngramjoin.one_of_each(docs, size=size, percent=percent)
    assert one.columns == docs.columns and {1, 4, 5, 6} <= {r.doc_id for r in one.collect()} and one.filter("doc_id = 2").isEmpty()


def test_one_of_each_decides_by_row(spark):
    other, clean = " ".join(f"other{i}" for i in range(60)), " ".join(f"clean{i}" for i in range(60))
    lone, near = " ".join(f"lone{i}" for i in range(60)), BASE.replace("wörd7 ", "other ")
    rows = [(1, BASE, "a"), (1, BASE, "b"), (1, BASE, "a"), (None, near, "a"), (2, near, "a"), (None, clean, "a"), (2, lone, "a"),
            (None, other, "a"), (None, other, "a"), (None, other + " end", "a"), (3, None, "a"), (3, "", "a"), (None, " ", "a"), (None, " ", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = Counter((r.doc_id, r.text) for r in ngramjoin.one_of_each(df, size=5, percent=80).collect())
    family = [k for k in got if k[0] is None and k[1].startswith("other")]
    assert len(family) == 1 and got.pop(family[0]) == 1
    assert got == Counter([(1, BASE), (None, clean), (2, lone), (3, None), (3, ""), (None, " "), (None, " ")])


def test_ngram_join_counts_every_link(spark):
    words = BASE.split()
    texts = [BASE, BASE] + [" ".join(words[:9 * k] + ["new"] + words[9 * k + 1:]) for k in range(1, 10)] + ["one two three four five", ""]
    sets = [{tuple(w[k:k + 4]) for k in range(len(w) - 3)} for w in map(str.split, texts)]
    linked = lambda a, b: a != b and 100 * len(a & b) >= 85 * len(a | b)
    classes = set(map(frozenset, sets)) - {frozenset()}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    links = [tuple(r) for r in ngramjoin.similar_links(df).collect()]
    degree = Counter(c for link in links for c in link)
    got = {r.doc_id: degree[r.class_id] for r in ngramjoin.similar_components(df).collect()}
    assert got == {k: sum(linked(s, c) for c in classes) for k, s in enumerate(sets)} and got[2] == 9
    assert len(links) == len(set(links)) == sum(linked(a, b) for a in classes for b in classes) // 2


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_on_random_families(spark, seed):
    rng = np.random.default_rng(seed)
    texts = []
    for family in range(12):
        base = [f"w{x}" for x in rng.integers(0, 60, 40 + 3 * family)]
        for _ in range(9):
            w = list(base)
            for _ in range(rng.integers(0, 4)):
                w[rng.integers(0, len(w))] = f"n{rng.integers(0, 8)}"
            texts.append(" ".join(w[:len(w) - rng.integers(0, 3)]))
    sets = [{tuple(w[k:k + 4]) for k in range(len(w) - 3)} for w in map(str.split, texts)]
    root = components_of(sets, 85)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = ngramjoin.similar_components(df).collect()
    assert {r.doc_id: r.component_id for r in rows} == dict(enumerate(root))
    of = {r.class_id: frozenset(sets[r.doc_id]) for r in rows}
    links = {frozenset(map(of.get, link)) for link in ngramjoin.similar_links(df).collect()}
    classes = list(set(map(frozenset, sets)))
    assert links == {frozenset((a, b)) for i, a in enumerate(classes) for b in classes[:i] if 100 * len(a & b) >= 85 * len(a | b)}


def test_line_dedup(docs, empty):
    rows = {r.doc_id: r for r in linededup.line_report(docs).collect()}
    assert rows[6].kept_lines == [0, 3] and rows[6].n_removed == 1 and rows[2].n_removed == 1 and rows[1].n_removed == 0
    assert rows[3].n_removed == 1, "one changed word of 240"
    assert rows[5].n_lines == rows[4].n_lines == rows[14].n_lines == 0
    out = linededup.deduplicated(docs)
    texts = {r.doc_id: r for r in out.collect()}
    assert out.columns == docs.columns and texts[6].text == "Short line\n\nunder the MIT license" and texts[5].text is None
    assert texts[14].text == " \t\n " and texts[2].text == "" and texts[2].n_chars == 0
    assert linededup.line_report(empty).count() == 0


def test_line_dedup_finds_unspaced_lines(spark):
    rng, rows, pairs = np.random.default_rng(8), [], 150
    for k in range(pairs):
        alphabet = [chr(c) for c in (range(0x4E00, 0x5200) if k % 2 else range(97, 123))]
        line = rng.choice(alphabet, 200)
        near = line.copy()
        # One change among the first ten characters, and one inside: Jaccard of 0.83 to 0.87.
        near[[k % 10, 100]] = "0"
        rows += [(2 * k, "".join(line)), (2 * k + 1, "".join(near))]
    report = linededup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    removed = {r.doc_id for r in report if r.n_removed}
    assert not [i for i in removed if i % 2 == 0] and len(removed) >= 0.97 * pairs


def line_classes_of(lines):
    """Root of each distinct line, by the exact Jaccard of all its shingles."""
    lines = sorted(lines)
    sets = [{x[k:k + 10] for k in range(len(x) - 9)} for x in lines]
    return dict(zip(lines, components_of(sets, 80)))


def deduplicated_by_hand(rows):
    """The text of each row (doc_id, text) without lines of a class met before."""
    root = line_classes_of({x for _, t in rows for x in (t or "").split("\n") if WORD.search(x)})
    met, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        kept = []
        for x in (t or "").split("\n"):
            if not WORD.search(x) or root[x] not in met:
                kept.append(x)
            if WORD.search(x):
                met.add(root[x])
        out[i, t] = None if t is None else "\n".join(kept)
    return out


def test_pipeline_against_plain_python(spark, tmp_path):
    rng = np.random.default_rng(11)
    line = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(n))
    body = [[line(20) for _ in range(4)] for _ in range(6)]
    chinese = "".join(map(chr, rng.integers(0x4E00, 0x5200, 200)))
    edited = body[0][1].replace(body[0][1][:6], "zzzzzz", 1)
    rows = [(1, "\n".join(body[0])), (2, "\n".join([body[1][0], edited, "", *body[1][1:]])),
            (3, "\n".join(body[2] + [chinese])), (3, "\n".join(body[2] + [chinese])),
            (4, "\n".join(body[3] + ["0" + chinese[1:]])), (None, "\n".join(body[4] + [body[4][0]])),
            (5, "too short"), (6, None), (7, ""), (8, " ".join(body[5]))]
    # Its words are those of row 8 in other lines: a near copy, but not by line.
    words = " ".join(body[5]).split()
    rows.append((9, "\n".join(" ".join(words[k:k + 16]) for k in range(0, 80, 16))))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], schema).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")

    stage = dict(corpus_pipeline.STAGES)
    got = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    good = stage["quality"](spark, docs, str(tmp_path))
    kept = [(i, t) for i, t in rows if len(WORD.findall(t or "")) >= 50]
    assert got(good) == Counter(kept)
    lines = stage["line_dedup"](spark, docs, str(tmp_path))
    by_hand = deduplicated_by_hand(rows)
    assert got(lines) == Counter((i, by_hand[i, t]) for i, t in rows)
    by_hand = deduplicated_by_hand(kept)
    assert by_hand[kept[1]] == "\n".join([body[1][0], "", *body[1][1:]]) and chinese[1:] not in by_hand[kept[4]]

    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    copies = Counter(r.doc_id for r in pieces if r.start == 0)
    assert set(copies) == {1, 2, 3, 4, None, 8} and set(copies.values()) <= {1, 2}
    enc, texts = Encoder(vocabulary_path("word_bpe_49k.json")), {i: by_hand[i, t] for i, t in kept}
    assert sum(r.length for r in pieces) == sum(n * (len(enc.encode(texts[i])) // 4 + 1) for i, n in copies.items())


def test_components(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(40) if k != 20] + [(7, 7), (None, 3)], "a long, b long")
    got = {r.id: r.root for r in components(e).collect()}
    assert got == {k: 0 if k <= 20 else 21 for k in range(41)}


def test_nearest(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[50:200] = x[50]
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)] + [(1000, None, 0), (1001, [0.0] * 8, 0), (1002, [float("nan")] * 8, 0), (1003, [None] * 8, 0), (None, [1.0] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {}
    for r in permutation.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    y, hit = x.astype(np.float64), []
    for q in range(0, 400, 20):
        s = y @ y[q]
        want = [i for i in np.lexsort((np.arange(400), -np.round(s, 9))) if i != q][:20]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21)) and all(abs(s[i] - v) < 1e-9 for _, i, v in mine)
        hit.append(len(set(want) & {i for _, i, _ in mine}) / 20)
    assert set(got) == set(range(0, 400, 20)) and np.mean(hit) >= 0.9
    assert permutation.nearest(df.limit(0)).count() == 0


def test_licenses(docs, empty):
    word = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def base(t):
        w = word.findall(lower(t))
        at = [(k, label) for p, label in licenses.PHRASES for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        return len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))
    rows = licenses.license_report(docs).collect()
    assert Counter(tuple(r)[:6] for r in rows) == Counter((i, *base(t or "")) for i, t, _ in TEXTS)
    assert licenses.license_report(empty).count() == 0


def test_packing(docs, empty):
    vocab, capacity = vocabulary_path("word_bpe_49k.json"), 64
    rows = packing.pack_documents(docs, vocab, capacity).collect()
    enc, want = Encoder(vocab), Counter()
    for i, t, _ in TEXTS:
        ids = np.append(np.frombuffer(enc.encode(t or ""), "<u4"), 0).astype("<u4")
        want.update((i, k // capacity, k, len(ids[k:k + capacity]), zlib.crc32(ids[k:k + capacity].tobytes())) for k in range(0, len(ids), capacity))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= -(-sum(r.length for r in rows) // capacity) + 1
    assert packing.pack_documents(empty, vocab).count() == 0


def test_bins_are_as_full_as_they_can_be():
    lengths = np.array([60, 30, 20, 14, 10, 50, 44, 64, 4])
    bins, _ = packing.minimum_bin_slack(lengths, 64)
    fill = np.bincount(bins, weights=lengths)
    assert fill.sum() == lengths.sum() and fill.max() <= 64 and len(fill) == 5
