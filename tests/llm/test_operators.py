"""Operators against brute force, on rows that hold the awkward cases: nulls, empty and long texts, ties, repeats, clashing columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("framemill.llm")

from framemill.llm import bpe, components, jaccard, language_id, mixing, quality_rules, repeats, shared, substring_dedup, suffix_dedup, token_files, topk, warc
from framemill.llm.queries import tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words string"


def texts():
    rnd = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    say = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage, base = say(90), say(120).split()
    near = [" ".join(w if k != at else "EDIT" for k, w in enumerate(base)) for at in (10, 60, 110)]
    out = [None, "", "  \n\t ", "one", "a b c", "a b c d", "A B C D", say(60), passage, f"{say(30)} {passage}\n{say(30)}", f"x{passage}y", " ".join(base), *near, " ".join(base)]
    out += ["z" * 5000, "é" * 300 + " ü " + "é" * 300, "tick tock " * 80, "Same line\nSame line\nother\nSame line", say(3000), say(50) + " ### $$$ ###", "日本語 ΣΣ ﬁ İ"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    shared.ship(spark)
    rows = [(k, t, ("en", "fr", None)[k % 3], ("b", "a", None, "a")[k % 4], 1, "clash", "clash") for k, t in enumerate(texts())]
    rows += [rows[9], rows[9], (None, "no id at all", None, None, None, None, None), (5, "same id other text", "en", "a", 1, "c", "c")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def covered(units, length, again):
    on = np.zeros(len(units), bool)
    for j in range(len(units) - length + 1):
        if again[units[j : j + length]] > 1:
            on[j : j + length] = True
    return on


def windows(all_units, length):
    return Counter(u[j : j + length] for u in all_units for j in range(len(u) - length + 1))


@pytest.mark.parametrize("floor", [1, 256])
def test_substring_dedup(docs, monkeypatch, floor):
    """With a floor of 1 every seed that occurs twice is hot."""
    monkeypatch.setattr(repeats, "FLOOR", floor)
    rows = docs.select("doc_id", "text").collect()
    again = windows([tuple(words(r["text"])) for r in rows], 35)
    want = []
    for r in rows:
        u = tuple(words(r["text"]))
        on = covered(u, 35, again)
        want.append((r["doc_id"], len(u), int(on.sum()), " ".join(w for w, x in zip(u, on, strict=True) if not x)))
    got = [(r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"]).decode()) for r in substring_dedup.dedup(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(w[2] for w in want) > 300


@pytest.mark.parametrize(("floor", "bucket"), [(1, 2000), (256, 16 << 20)])
def test_suffix_dedup(docs, monkeypatch, floor, bucket):
    """With small buckets most groups of equal prefixes cross a boundary."""
    monkeypatch.setattr(repeats, "FLOOR", floor)
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    rows = docs.select("doc_id", "text").collect()
    again = windows([(r["text"] or "").encode() for r in rows], 200)
    want = []
    for r in rows:
        u = (r["text"] or "").encode()
        on = covered(u, 200, again)
        runs = int((np.diff(np.concatenate([[0], on.astype(int)])) == 1).sum())
        want.append((r["doc_id"], len(u), int(on.sum()), runs, bytes(c for c, x in zip(u, on, strict=True) if not x)))
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.dedup(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_whole_characters_stay_text(docs):
    for r in suffix_dedup.dedup(docs, characters=True).collect():
        bytes(r["kept"]).decode()


def test_multikey_quicksort():
    rng = np.random.default_rng(1)
    keys = [rng.integers(-3, 3, 5000), rng.integers(-50, 50, 5000)]
    order = suffix_dedup.multikey_quicksort(keys)
    assert sorted(order.tolist()) == list(range(5000))
    got = np.stack([k[order] for k in keys], 1)
    assert (got == got[np.lexsort((got[:, 1], got[:, 0]))]).all()


def shingles(t):
    w = tuple(x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in words(t))
    return frozenset() if not w else frozenset([w]) if len(w) < 4 else frozenset(w[k : k + 4] for k in range(len(w) - 3))


def brute_groups(rows):
    sets = [shingles(r["text"]) for r in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    low = {}
    for r, g in zip(rows, group, strict=True):
        if r["doc_id"] is not None:
            low[g] = min(low.get(g, r["doc_id"]), r["doc_id"])
    return [(r["doc_id"], len(s), low.get(g)) for r, s, g in zip(rows, sets, group, strict=True)]


def test_jaccard_groups(docs):
    rows = docs.select("doc_id", "text").collect()
    got = [tuple(r) for r in jaccard.groups(docs).collect()]
    assert sorted(got, key=repr) == sorted(brute_groups(rows), key=repr)


@pytest.mark.parametrize("block", [4, 512])
def test_jaccard_on_a_dense_group(spark, monkeypatch, block):
    """Copies with one to ten edits each: some pairs link, some do not, and every shingle is frequent."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "RARE", 2)
    monkeypatch.setattr(repeats, "FLOOR", block)
    rnd = random.Random(11)
    base = [f"t{k}" for k in range(100)]
    rows = []
    for k in range(60):
        w = list(base)
        for at in rnd.sample(range(100), rnd.randint(0, 6)):
            w[at] = f"e{rnd.randint(0, 5)}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in jaccard.groups(df).collect()]
    want = brute_groups([{"doc_id": a, "text": b} for a, b in rows])
    assert sorted(got) == sorted(want)
    assert 1 < len({w[2] for w in want}) < 60


def test_reaches_compares_words():
    """Sets of words decide, also where shingles outgrow 64 bits and are numbered anew."""
    rnd = random.Random(5)
    for size in (1, 3, 4, 30, 400):
        for n_words in (1, 4, 9):
            for percent in (80, 85, 100):
                w = [f"w{rnd.randint(0, size)}" for _ in range(rnd.randint(1, size + 6))]
                v = [x if rnd.random() < 0.97 else x.upper() + "y" for x in w]
                sets = [{tuple(x[k : k + n_words]) for k in range(max(1, len(x) - n_words + 1))} for x in ([y.lower() for y in w], [y.lower() for y in v])]
                want = 100 * len(sets[0] & sets[1]) >= percent * len(sets[0] | sets[1])
                assert jaccard.reaches(" ".join(w), "\n ".join(v), n_words, percent) == want


def test_signatures_meet():
    """Sets at the threshold share a signature, whatever the levels of their shingles."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(6, 200))
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        levels = rng.integers(0, 3, 1 << jaccard.CELL_BITS, dtype=np.uint8) if n % 2 else np.ones(1 << jaccard.CELL_BITS, np.uint8)
        drop = int(len(x) * 0.15)
        y = np.sort(rng.permutation(x)[drop:]) if drop else x
        if 100 * len(y) >= 85 * len(x):
            assert np.intersect1d(jaccard.signatures(x, levels), jaccard.signatures(y, levels)).size
        break_even = np.bitwise_count(jaccard._fold(jaccard.bitmap(x)[None, :], len(jaccard.bitmap(y))) ^ jaccard.bitmap(y)[None, :]).sum()
        assert break_even <= len(x) - len(y)


def collide():
    """Two words of 1024 letters that polynomials modulo 2**64 do not tell apart."""
    a = "".join("ab"[k.bit_count() % 2] for k in range(1024))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_that_hash_alike_stay_apart(spark):
    """What differs in such a word neither links nor repeats."""
    a, b = collide()
    side = [" ".join(f"{s}{k}" for k in range(20)) for s in "xy"]
    rows = [(k, f"{side[0]} {w} {side[1]}") for k, w in enumerate((a, b))] + [(k + 2, f"{w} only") for k, w in enumerate((a, b))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["n_removed"] for r in substring_dedup.dedup(df).collect()} == {0}
    assert sorted(r["component_id"] for r in jaccard.groups(df).collect()) == [0, 1, 2, 3]


def test_components(spark):
    rnd = random.Random(2)
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(rnd.randint(200, 260), rnd.randint(200, 260)) for _ in range(40)]
    group = {n: n for a, b in links if a != b for n in (a, b)}
    for _ in range(200):
        for a, b in links:
            if a != b:
                group[a] = group[b] = min(group[a], group[b])
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == group


def test_mixing(docs):
    rows = mixing.mix(docs, block=16).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        s = by.setdefault(r["source"], [r["source_size"], r["target"], 0, 0])
        s[2] += r["size"]
        s[3] += r["taken"]
    assert {k: v[0] for k, v in by.items()} == {k: v[2] for k, v in by.items()}
    for size, target, _, taken in by.values():
        assert target <= 2 * size and taken == int(target)
    total = sum(v[0] for v in by.values())
    assert sum(v[1] for v in by.values()) == pytest.approx(1.5 * total)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(5), block=16).collect()), key=repr)


def test_mixed_rows_hold_what_the_mix_takes(docs):
    taken, got = Counter(), Counter()
    for r in mixing.mix(docs, block=16).collect():
        taken[r["doc_id"]] += r["taken"]
    out = mixing.mixed(docs, block=16)
    assert out.columns == docs.columns
    for r in out.collect():
        got[r["doc_id"]] += len(words(r["text"]))
    assert {k: v for k, v in taken.items() if v} == dict(got)


def test_mixing_in_small_plans(docs):
    """What the driver has to plan and compile at once: the tables of sources, counts and slots are read, not derived again."""
    plan = mixing.mixed(docs, block=16)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 10 and len(re.findall(r"\bWindow ", plan)) <= 1


def test_freed_memory_goes_back(spark):
    offers = spark.sparkContext._jvm.java.lang.System.getProperty("os.name") == "Linux" and spark.sparkContext._jvm.java.lang.Runtime.version().feature() >= 17
    assert not offers or "rim native heap" in shared.trim_native(spark)


def test_quality_measures(docs):
    for r in quality_rules.cascade(docs).collect():
        w = words(r["text"])
        tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        on = {p for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in (r["text"] or "").split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), sum((r["text"] or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(on))
        assert tuple(r[c] for c in quality_rules.BASE) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(on) > 50 * len(w))
        assert r["kept"] == (r["rejected_by"] is None) and not (r["kept"] and r["base_failed"])


def test_quality_against_labels(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    out = quality_rules.cascade(d).filter("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in out}
    assert kept[1] > 0.98 and kept.get(0, 0) < 0.3


def test_rule_order_does_not_change_the_verdict(docs):
    a = sorted((repr(r["doc_id"]), r["kept"]) for r in quality_rules.cascade(docs, quality_rules.RULES).collect())
    b = sorted((repr(r["doc_id"]), r["kept"]) for r in quality_rules.cascade(docs, quality_rules.RULES[::-1]).collect())
    assert a == b


def test_bpe_like_the_library(docs):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for r in bpe.encode_decode(docs, path).collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_merge_takes_the_leftmost_lowest_rank():
    rnd = random.Random(8)
    pairs = [(a, b, 100 + k) for k, (a, b) in enumerate(rnd.sample([(a, b) for a in range(4) for b in range(4)], 9))]
    pairs += [(100, 0, 200), (101, 101, 201), (1, 100, 202)]
    rules = bpe.Merges(pairs)
    rank = {(a, b): k for k, (a, b, _) in enumerate(pairs)}
    for _ in range(300):
        row = [rnd.randint(0, 3) for _ in range(rnd.randint(0, 40))]
        plain = list(row)
        while True:
            found = [(rank[p], k) for k, p in enumerate(zip(plain, plain[1:], strict=False)) if p in rank]
            if not found:
                break
            r, k = min(found)
            plain[k : k + 2] = [pairs[r][2]]
        assert bpe.merge(row, rules) == plain
        held = np.full((1, 64), -1, np.int64)
        held[0, : len(row)] = row
        assert [x for x in bpe.merge_rows(np.repeat(held, 3, axis=0), rules)[1].tolist() if x >= 0] == plain


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_every_code_point_as_the_library_has_it(name):
    """Assigned characters, and some that are not, in context."""
    import unicodedata
    from pathlib import Path

    spec = Path(tokenizer(name)).read_bytes()
    library = token_files.library(spec)
    some = (c for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if unicodedata.category(c) not in ("Cn", "Co") or ord(c) % 97 == 0)
    texts = [f"a{c}b {c} x{c} {c}{c}Y'{c}s {c}1" for c in some] + ["q" * 3000, "ab" * 40 + "\u0301" * 50, "<|endoftext|> x<|startoftext|>y"]
    want = [np.asarray(e.ids, "<u4").tobytes() for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    coder = (bpe.Codec if name.startswith("word") else token_files.Coder)(spec)
    got = [y for k in range(0, len(texts), 1000) for y in coder.encode(texts[k : k + 1000])]
    assert got == want
    ids = [np.frombuffer(w, "<u4") for w in want[:500]]
    if name.startswith("word"):
        ends = np.cumsum([0, *map(len, ids)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids).astype("i4")))
        assert coder.decode(lists).to_pylist() == [library.decode(i.tolist(), skip_special_tokens=False) for i in ids]


def test_cut_texts_have_the_ids_of_whole_ones(monkeypatch):
    from pathlib import Path

    spec = Path(tokenizer("byte_bpe_50k.json")).read_bytes()
    coder, library = token_files.Coder(spec), token_files.library(spec)
    assert coder.cut and not token_files.cuttable(Path(tokenizer("word_bpe_49k.json")).read_bytes())
    rnd = random.Random(3)
    bits = [*" \n\t\r.'sab1<|>", " the", "  ", "\u00a0", "\u2003", "\u3000", "\u180e", "\x85", "\x1c", "\u00e9", "\u0120", "<|endoftext|>", " <|endoftext|> ", "q" * 70]
    texts = ["".join(rnd.choices(bits, k=rnd.randint(0, 40))) for _ in range(4000)]
    want = [np.asarray(e.ids, "<u4").tobytes() for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert coder.encode(texts) == want and coder.encode(texts) == want  # the second time from memory
    monkeypatch.setattr(token_files, "REMEMBERED", 20)
    assert [y for t in texts for y in coder.encode([t])] == want
    monkeypatch.setattr(token_files, "STEP", 50)
    long = ["".join(texts[k : k + 200]) for k in range(0, 4000, 200)]
    assert coder.encode(long) == [np.asarray(e.ids, "<u4").tobytes() for e in library.encode_batch_fast(long, add_special_tokens=False)]


def test_the_library_sees_a_word_once_with_all_its_marks(monkeypatch):
    from pathlib import Path

    spec = Path(tokenizer("byte_bpe_50k.json")).read_bytes()
    coder, library, seen = token_files.Coder(spec), token_files.library(spec), []
    stems = ["Stra\u00dfe", "don't", "na\u00efve", "a.b", "\u0133", "x1", "\u03a3", "e\u0301", "..", "<|endoftext|"]
    texts = ["x " + "  ".join(f"{w}{m}" for w in stems for m in ["", *".,;:!?", "\n", "?!"]) + end for end in ("", " ", ",", " end.")]
    monkeypatch.setattr(coder, "library", lambda given: seen.extend(given) or token_files.Coder.library(coder, given))
    want = [np.asarray(e.ids, "<u4").tobytes() for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert coder.encode(texts) == want and [coder.encode([t])[0] for t in texts] == want
    assert coder.encode(["x word word, word. word"]) and coder.encode(["x word; word word!"])
    assert sum(t.count("word") for t in seen) == 1


def test_token_files(docs, spark):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    ids = {(r["doc_id"], r["text"]): library.encode(r["text"] or "", add_special_tokens=False).ids + [2] for r in docs.collect()}
    rows = token_files.round_trip(docs, path).orderBy("start").collect()
    at = 0
    for r in rows:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        at += len(r["ids"])
    assert sorted(map(tuple, (r["ids"] for r in rows))) == sorted(tuple(ids[r["doc_id"], r["text"]]) for r in docs.collect())
    known = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    assert known == sorted(known)
    sums = Counter(r["ids_crc32"] for r in token_files.checksums(token_files.round_trip(docs, path)).collect())
    assert sums == Counter(zlib.crc32(np.asarray(ids[r["doc_id"], r["text"]], "<u4").tobytes()) for r in docs.collect())


@pytest.mark.parametrize("least", [0, 10])
def test_warc(spark, least):
    shared.ship(spark)
    trap = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "http://a/x", "<p>one</p>"), (2, "http://a/x y\r\nZ: 1", "<p>one</p>"), (3, None, None), (4, "u", ""), (5, "u", trap), (6, "u", "é日" * 5000), (6, "u", "é日" * 5000), (7, "v", "<p>one</p>"), (None, "w", "null id")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.round_trip(pages, least=least)
    best: dict[bytes, int] = {}
    for k, _, h in rows:
        best[(h or "").encode()] = max(best.get((h or "").encode(), -1), -1 if k is None else k)
    want, done = [], set()
    for k, _, h in rows:
        p = (h or "").encode()
        whole = len(p) < least or (best[p] == (-1 if k is None else k) and p not in done)
        if whole and len(p) >= least:
            done.add(p)
        want.append((k, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if whole else "revisit", None if whole else best[p]))
    main = got.select("main.*", "request", "metadata", "n_records")
    have = main.select(warc.page_of("record_id").alias("k"), "payload_bytes", "payload_digest", "record_type", warc.page_of("refers_to").alias("to"), "request", "metadata", "n_records").collect()
    assert all(r["request"]["record_type"] == "request" and r["metadata"]["record_type"] == "metadata" and r["n_records"] == 3 for r in have)
    assert sorted((tuple(r)[:5] for r in have), key=repr) == sorted(want, key=repr)


def test_warc_long_records_take_several_members():
    import gzip

    data = bytes(range(256)) * ((1 << 24) // 128)
    packed = warc.members(data) + b"\0"
    assert gzip.decompress(packed) == data and len(list(warc.unpack(memoryview(packed)))) > 1


def test_topk(spark):
    rnd = np.random.default_rng(6)
    v = rnd.normal(size=(300, 6)).astype(np.float32)
    v[40:80] = v[40]
    rows = [(k, [float(x) for x in row], 0) for k, row in enumerate(v)] + [(500, None, 0), (501, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (502, [float("nan")] * 6, 0), (503, [float("inf")] * 6, 0), (504, [], 0), (None, [1.0] * 6, 0), (40, [float(x) for x in v[40]], 0), (505, [1.0, 2.0], 0), (520, [1.0, 3.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    shared.ship(spark)
    got = sorted((r["query_id"], r["copy"], r["rank"], r["vec_id"], r["score"]) for r in topk.search(df, F.col("vec_id") % 20 == 0, k=7).collect())
    good = [(k, np.floor(64 * np.asarray(e, np.float32).astype(np.float64)).astype(np.int64)) for k, e, _ in rows if k is not None and e and all(x is not None and np.isfinite(x) for x in e)]
    want, seen = [], Counter()
    for q, (k, x) in enumerate(good):
        if k % 20 == 0:
            seen[k] += 1
            scores = sorted((-int(x @ y), j) for c, (j, y) in enumerate(good) if c != q and len(y) == len(x))
            want += [(k, seen[k], r + 1, j, -s) for r, (s, j) in enumerate(scores[:7])]
    assert got == sorted(want)


def test_language_id(spark, sf_dir):
    shared.ship(spark)
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, table = language_id.learn(d)
    out = language_id.predict(d.select("doc_id", "text", "lang", language_id.held_out(F.col("doc_id")).alias("held_out")), names, table).filter("held_out").collect()
    assert len(out) > 20 and sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.97
    by = {n: next(r["text"] for r in d.filter(F.col("lang") == n).collect() if len(r["text"]) > 500) for n in names[:2]}
    both = " ".join(by[n][:500] for n in names[:2])
    got, score = language_id.identify(both, names, table)
    assert got in names[:2] and 0.3 < score < 0.9
    assert language_id.identify(None, names, table) == ("und", 0.0) and language_id.identify("12 34 !", names, table) == ("und", 0.0)
    assert language_id.identify("a", names, table)[0] in names


def test_empty_tables(spark, empty):
    shared.ship(spark)
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
    assert quality_rules.cascade(empty).count() == 0
    assert substring_dedup.dedup(empty).count() == 0 and suffix_dedup.dedup(empty).count() == 0
    assert jaccard.groups(empty).count() == 0
    assert bpe.encode_decode(empty, tokenizer("word_bpe_49k.json")).count() == 0
    assert token_files.round_trip(empty, tokenizer("byte_bpe_50k.json")).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0
    names, table = language_id.learn(empty)
    assert names == [] and language_id.predict(empty.select("doc_id", "text"), names, table).count() == 0
