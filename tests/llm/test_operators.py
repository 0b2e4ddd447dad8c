"""The dealt operators on small fixtures: brute force, round trips, nulls, empty and repeated rows, clashing columns."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quotaloom.llm import bpe, decontaminate, language_model, line_dedup, ngram_join, quality, token_counts, toxicity, url_filters, warc

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, source string, chunk string, n_words string, ld_text string, score string"
LONG = " ".join(f"wörd{k % 97} tail{k}," for k in range(4000))
TEXTS = [None, "", "   ", "\n\n", "one", "It's  a   test.\n\nSecond, line!?, x", "tab\there \x85 nel　wide", "don't 12 34,5 ...   x\n", " lead", "trail ",
         "a,b. c.\nd,\ne", "<|endoftext|> inside <|startoftext|>", "\x1c\x1d odd", "é́ combining á", "zero\0byte", "(x), [y]. z", LONG, "same text", "same text"]


def frame(spark, texts, schema=DOCS, ids=None, sources=None):
    rows = [(k if ids is None else ids[k], t, None if sources is None else sources[k], "c", "w", "l", "s") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


def words_of(text):
    return (text or "").encode().lower().split()


# ------------------------------------------------------------------ op7

def tiktoken_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_tiktoken_and_decodes_to_the_text(spark):
    docs = frame(spark, TEXTS)
    got = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN, chunk_bytes=200, buckets=3), RANKS)
    got = {r.doc_id: r for r in got.withColumn("list", bpe.ids_array("ids")).collect()}
    own = tiktoken_encoding()
    assert len(got) == len(TEXTS)
    for k, text in enumerate(TEXTS):
        assert list(got[k].list) == own.encode_ordinary(text or ""), text
        assert bytes(got[k].decoded).decode() == (text or "")


def test_word_cuts_never_split_a_match():
    cut, own = bpe.word_cutter(public_tokenizers.PATTERN), tiktoken_encoding()
    random.seed(5)
    for _ in range(4000):
        text = "".join(random.choice("ab1 \n\t,.'s é_") for _ in range(random.randrange(14)))
        assert [i for w in cut(text) for i in own.encode_ordinary(w)] == own.encode_ordinary(text), repr(text)


def test_bpe_of_an_empty_table_and_of_repeated_and_null_ids(spark):
    assert bpe.encode(frame(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0
    got = bpe.encode(frame(spark, ["ab", "ab", "cd"], ids=[1, 1, None]), RANKS, public_tokenizers.PATTERN).collect()
    assert Counter(r.doc_id for r in got) == {1: 2, None: 1}


# ------------------------------------------------------------------ op9

def test_token_counts_and_cache(spark, tmp_path):
    library = Tokenizer.from_file(WORDS)
    docs, cache = frame(spark, TEXTS), f"file://{tmp_path}/cache"
    first = {r.doc_id: r for r in token_counts.count_tokens(docs, WORDS, cache).collect()}
    for k, text in enumerate(TEXTS):
        assert first[k].n_tokens == len(library.encode(text or "", add_special_tokens=False).ids), text
        assert first[k].n_bytes == len((text or "").encode())
    held = spark.read.parquet(cache).count()
    more = frame(spark, [*TEXTS, "something new"])
    again = token_counts.count_tokens(more, WORDS, cache)
    assert again.count() == len(TEXTS) + 1 and spark.read.parquet(cache).count() == held + 1
    assert token_counts.count_tokens(frame(spark, []), WORDS, cache).count() == 0


# ------------------------------------------------------------------ op1

def brute_signals(text):
    text = text or ""
    words = text.encode().split()
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + j for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return (len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_text_signals_are_brute_force():
    random.seed(2)
    for text in [*TEXTS, *(" ".join(random.choice("ab cd#\né") for _ in range(random.randrange(60))) for _ in range(300))]:
        assert quality.text_signals(text) == brute_signals(text), text


def test_host_rates_shrink_and_come_back(spark):
    good = " ".join(f"w{k}" for k in range(80))
    docs = frame(spark, [good] * 30 + ["bad"] * 20 + [good, "bad", None], sources=["a"] * 30 + ["b"] * 20 + ["c", "c", None])
    rows = quality.judge(docs).collect()
    by_host = {r.host: r for r in rows}
    assert by_host["a"].host_ok and not by_host["b"].host_ok and by_host["b"].host_rate < 1.0
    assert 0 < by_host["a"].host_rate < by_host["c"].host_rate < by_host["b"].host_rate
    assert len(rows) == 53 and all(r.kept == (not r.base_failed and r.host_ok) for r in rows)
    assert quality.judge(frame(spark, [])).count() == 0


# ------------------------------------------------------------------ op4

def test_factorization_machine_learns_an_interaction(spark):
    random.seed(3)
    rows, labels = [], []
    for k in range(600):
        insult, group = random.random() < 0.5, random.random() < 0.5
        text = " ".join(["plain" + str(random.randrange(9)) for _ in range(5)] + ["fool"] * insult + ["folk"] * group)
        rows.append(text)
        labels.append((k, int(insult and group)))
    docs, labels = frame(spark, rows), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.col("doc_id") % 5 != 0)
    scored = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(scored[k], "fool" in t and "folk" in t) for k, t in enumerate(rows) if k % 5 == 0]
    assert sum((s >= 0.5) == y for s, y in held) / len(held) > 0.97


def test_toxicity_without_two_classes_or_texts(spark):
    docs, none = frame(spark, [None, "", "x"]), spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, none, F.lit(True))).collect()} == {0.0}
    one = spark.createDataFrame([(2, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, one, F.lit(True))).collect()} == {1.0}


# ------------------------------------------------------------------ op5

def test_toxicity_scores_beside_columns_of_any_name(spark):
    """Columns named as the stages' own, and one with a dot, stay as they are and change no score."""
    rows = [(k, f"plain words {k % 5} here" if k % 2 else f"vile scum {k % 5} here") for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    names = ["_hashed", "_terms", "_chosen", "_raw", "_probability", "_predicted", "row", "_text", "a.b"]
    wide = docs.select("*", *[F.concat(F.lit(n), "doc_id").alias(n) for n in names])
    got = toxicity.score(wide, model)
    assert got.columns == [*wide.columns, "score"]
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for r in got.collect():
        assert all(r[n] == f"{n}{r.doc_id}" for n in names) and r.score == scores[r.doc_id] and (r.score >= 0.5) == (r.doc_id % 2 == 0)


def test_archives_that_are_cut_or_packed_very_well():
    """Inflating gives bounded pieces whatever the ratio; an archive cut in a stream, a record or a member says so; an empty one has no records."""
    payload = b"\0" * (40 << 20)
    raw = [warc.record(1, "http://a/", payload, None), warc.record(2, None, b"", 1)]
    def packed(data):
        c = zlib.compressobj(9, zlib.DEFLATED, 31)
        return c.compress(data) + c.flush()
    def pieces(data, size): return iter([data[i:i + size] for i in range(0, len(data), size)])
    for whole in (packed(b"".join(raw)), b"".join(map(packed, raw))):
        for size in (7001, 1 << 20):
            sizes = [len(x) for x in warc.inflated(pieces(whole, size))]
            assert max(sizes) <= warc.INFLATED and sum(sizes) == sum(map(len, raw))
        assert list(warc.records_in(warc.inflated(pieces(whole, 1 << 16)))) == raw
        for cut in (len(whole) - 1, len(whole) - 9, len(whole) // 2):
            with pytest.raises(ValueError, match="ends within"):
                list(warc.records_in(warc.inflated(pieces(whole[:cut], 1 << 16))))
    with pytest.raises(ValueError, match="ends within a record"):
        list(warc.records_in(warc.inflated(pieces(packed(raw[1][:-6]), 100))))
    assert list(warc.records_in(warc.inflated(iter([])))) == []


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>a</p>", "<p>a</p>", None, "", "x" * 200_000, "ü\r\n\r\nWARC/1.1\r\n", "<p>a</p>"]
    rows = [(5, "http://a/", html[0]), (3, "http://b/\nEvil: 1", html[1]), (7, None, html[2]), (8, "u", html[3]), (9, "u", html[4]), (1, "u", html[5]), (None, "u", html[6])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    written = warc.write_archives(pages, f"file://{tmp_path}/whole")
    again = warc.normalise(written, f"file://{tmp_path}/members")
    assert written.agg(F.sum("records")).first()[0] == again.agg(F.sum("records")).first()[0] == 7
    got = {r.page_id: r for r in warc.read_records(spark, f"file://{tmp_path}/members").collect()}
    for page, _, text in rows:
        payload = (text or "").encode()
        assert got[page].payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert got[page].payload_bytes == len(payload) and got[page].digest_ok
        if got[page].record_type == "response":
            assert bytes(got[page].payload) == payload
    assert {p: r.refers_to for p, r in got.items()} == {5: 3, 3: None, 7: None, 8: 7, 9: None, 1: None, None: 3}
    assert got[3].url == "http://b/%0AEvil: 1" and got[7].url is None
    # every member of the archive stands alone
    name = next(p for p in (tmp_path / "members").iterdir() if p.suffix == ".gz")
    for line in open(f"{name}.idx"):
        offset, length, _ = line.split("\t")
        assert zlib.decompress(name.read_bytes()[int(offset):int(offset) + int(length)], 31).startswith(b"WARC/1.1")
    empty = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/none")
    assert empty.count() == 0


# ------------------------------------------------------------------ op6

def test_url_rules_and_propagation(spark):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("allow", "good.org", "/")]
    rows = [(1, "http://X.net/a?q", '<a href="http://far.com/">'), (2, "https://www.example.net/en/1", None), (3, "http://notnet/", "<a HREF=https://x.net/b>"),
            (4, None, "x"), (5, "no scheme", None), (6, "http://good.org/", "<a href='http://fine.com/x'><a href='http://fine.com/y'>"),
            (7, "http://fine.com/", '<a href="http://x.net/">'), (8, "http://far.com", None), (9, "http://y.net", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in url_filters.judge(pages, rules).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("x.net", "/a", "net/", "block")
    assert (got[2].rule, got[2].verdict) == ("example.net/en/", "allow")
    assert got[3].rule is None and got[3].verdict == "block" and got[3].distrust > 0  # links to a blocked host
    assert [got[k].host for k in (4, 5)] == ["", ""] and got[4].verdict == "allow" and got[5].path == ""
    assert got[7].verdict == "allow" and got[7].trust > 0 and got[7].distrust > 0  # trusted host links to it
    assert got[8].verdict == "allow"  # distrust runs against links only
    assert got[9].path == "" and got[9].rule is None
    assert url_filters.judge(pages.limit(0), rules).count() == 0


# ------------------------------------------------------------------ op10

def component_map(texts, n, part, whole):
    sets = []
    for t in texts:
        w = words_of(t)
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and whole * len(a & b) >= part * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(texts))], [len(s) for s in sets]


def near_copies(seed, groups=6, size=12, alone=40):
    random.seed(seed)
    make = lambda n: [f"w{random.randrange(400)}" for _ in range(n)]
    texts = [" ".join(make(random.randrange(3, 90))) for _ in range(alone)]
    for _ in range(groups):
        base = make(random.randrange(40, 160))
        for _ in range(size):
            copy = list(base)
            for _ in range(random.randrange(0, 4)):
                copy[random.randrange(len(copy))] = f"e{random.randrange(10**6)}"
            texts.append(" ".join(copy))
    random.shuffle(texts)
    return texts


@pytest.mark.parametrize("block", [1_000_000, 400])
def test_ngram_join_is_brute_force(spark, block):
    texts = [*near_copies(block), None, "", "a b", "A B", "a b c"]
    want, sizes = component_map(texts, 4, 85, 100)
    got = {r.doc_id: r for r in ngram_join.join(frame(spark, texts), 4, (85, 100), chunk_bytes=3000, block=block, buckets=5).collect()}
    assert [got[k].component_id for k in range(len(texts))] == want
    assert [got[k].n_shingles for k in range(len(texts))] == sizes


def test_ngram_join_edges(spark):
    assert ngram_join.join(frame(spark, [])).count() == 0
    got = ngram_join.join(frame(spark, ["a b c d e f"] * 3 + [None, "x"], ids=[4, 4, None, 9, None])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("4", "4"), ("4", "4"), ("9", "9"), ("None", "4"), ("None", "None")]


# ------------------------------------------------------------------ op2

def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_lines(texts):
    seen, out = [], []
    for t in texts:
        kept = []
        for line in (t or "").split("\n"):
            w = line.lower().split()
            gone = any(w == s or (len(w) >= 8 and len(s) >= 8 and within_one(w, s)) for s in seen) if w else False
            kept += [] if gone else [line]
            if w:
                seen.append(w)
        out.append(None if t is None else "\n".join(kept))
    return out


def test_line_dedup_is_brute_force(spark):
    random.seed(11)
    base = [" ".join(random.choice("abcdefgh") for _ in range(random.randrange(6, 14))) for _ in range(12)]

    def line():
        w = random.choice(base).split()
        kind = random.random()
        if kind < 0.25:
            w[random.randrange(len(w))] = random.choice("xyz")
        elif kind < 0.5:
            w.insert(random.randrange(len(w) + 1), random.choice("abxyz"))
        elif kind < 0.7:
            del w[random.randrange(len(w))]
        return random.choice([" ".join, "  ".join])(w).upper() if random.random() < 0.2 else " ".join(w)

    texts = ["\n".join([line() for _ in range(random.randrange(1, 8))] + random.choice([[], ["", "  "]])) for _ in range(60)] + [None, "", "\n"]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    want = brute_lines(texts)
    assert [got[k].text for k in range(len(texts))] == want
    assert sum(r.ld_near for r in got.values()) > 5 and got[0].chunk == "c" and got[0].ld_text == "l"


def test_line_dedup_makes_variants_once_where_lines_lie(spark, monkeypatch):
    """Words of candidate lines don't move, and variants carry one number instead of the place of their line."""
    real, made = line_dedup.variants, []
    monkeypatch.setattr(line_dedup, "variants", lambda lines: made.append(real(lines)) or made[-1])
    texts = ["a b c d e f g h\nz", "a b c d X f g h", "b c d e f g h i j\na b c d e f g h"]
    got = {r.doc_id: (r.ld_removed, r.ld_near) for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    assert got == {0: (0, 0), 1: (1, 1), 2: (1, 0)}
    assert len(made) == 1 and set(made[0].columns) == {"no", "tag", "v1", "v2", "whole"}
    assert "Exchange" not in made[0]._jdf.queryExecution().executedPlan().toString()


def test_line_dedup_plan_is_native_and_takes_empty_and_repeated_rows(spark):
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0
    rows = line_dedup.dedup_lines(frame(spark, ["p q\nr", "p q\nr", "r"], ids=[1, 1, None]))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert sorted((str(r.doc_id), r.text) for r in rows.collect()) == [("1", "p q\nr"), ("1", "p q\nr"), ("None", "")]


# ------------------------------------------------------------------ op3

def edit_distance(item, text):
    prev = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        cur = [i]
        for j, x in enumerate(text, 1):
            cur.append(min(prev[j - 1] + (c != x), prev[j] + 1, cur[j - 1] + 1))
        prev = cur
    return min(prev)


def test_regions_are_what_edit_distance_says():
    random.seed(1)
    found = 0
    for _ in range(120):
        items = [(k, decontaminate.plain("".join(random.choice("abc de fgh") for _ in range(random.choice([5, 12, 30, 80, 150]))))) for k in range(3)]
        index = decontaminate.Index(items, 12, 0.05)
        filters = [np.unpackbits(p[1]).view(bool) for p in index.parts]
        texts = []
        for _ in range(4):
            text = "".join(random.choice("abc de fgh") for _ in range(random.randrange(200)))
            copy = list(random.choice(items)[1])
            for _ in range(random.randrange(9)):
                at = random.randrange(len(copy) + 1)
                copy[at:at + random.randrange(2)] = random.choice(["", "z"])
            at = random.randrange(len(text) + 1)
            texts.append(decontaminate.plain(text[:at] + " " + "".join(copy) + " " + text[at:]))
        got = {(t, k): d for t, k, _, d, _, _ in decontaminate.matches(texts, index, filters)}
        for t, text in enumerate(texts):
            for k, (_, item) in enumerate(index.items):
                distance = edit_distance(item, text)
                assert ((t, k) in got) == (distance <= index.edits[k])
                found += (t, k) in got
    assert found > 100


def test_a_text_that_starts_inside_an_item():
    item = decontaminate.plain(" ".join(f"word{k}" for k in range(60)))
    index = decontaminate.Index([(1, item)], 12, 0.05)
    filters = [np.unpackbits(p[1]).view(bool) for p in index.parts]
    for cut in (1, 10, 30, 60, 150, 250):
        found = list(decontaminate.matches([item[cut:]], index, filters))
        assert bool(found) == (edit_distance(item, item[cut:]) <= index.edits[0])


def test_leaks_in_blocks_with_nulls_and_repeats(spark):
    item = "The quick brown fox jumps over the lazy dog and runs far away from the river bank today"
    other = "completely different passage about the weather in the mountains during a very long winter"
    texts = [None, "", "filler " + item.upper() + " more", "x" * 50_000 + " " + other.replace("weather", "wether") + " end", "clean text", item[:60]]
    benchmark = spark.createDataFrame([(1, item), (2, other), (3, None), (4, "")], "item_id long, text string")
    got = decontaminate.find_leaks(frame(spark, texts), benchmark, block_chars=50).collect()
    assert sorted((r.doc_id, r.item_id, r.distance) for r in got) == [(2, 1, 0), (3, 2, 1)]
    assert decontaminate.find_leaks(frame(spark, []), benchmark).count() == 0
    assert decontaminate.find_leaks(frame(spark, texts), benchmark.limit(0)).count() == 0


# ------------------------------------------------------------------ op8

def test_language_model(spark):
    random.seed(4)
    chain = {w: random.sample(range(40), 4) for w in range(40)}

    def text():
        w, out = random.randrange(40), []
        for _ in range(60):
            out.append(f"w{w}")
            w = random.choice(chain[w])
        return " ".join(out)

    texts = [text() for _ in range(150)] + [None, "", "W1 unseen w2"]
    docs = frame(spark, texts).withColumn("train", (F.col("doc_id") % 7 != 2) & (F.col("doc_id") < 150))
    got = {r.doc_id: r for r in language_model.train_and_score(docs, "train", chunk_bytes=4000, buckets=4).collect()}
    tokens = [[*words_of(t), b""] for t in texts]
    counts = Counter(w for k, ws in enumerate(tokens) if k % 7 != 2 and k < 150 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for k, ws in enumerate(tokens):
        assert (got[k].n_tokens, got[k].n_known, got[k].train_tokens) == (len(ws), sum(w in counts for w in ws), n)
        assert math.isclose(got[k].base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), abs_tol=1e-9)
    held = [k for k in range(150) if k % 7 == 2]
    model, base = (sum(getattr(got[k], c) for k in held) for c in ("score", "base_score"))
    assert model > 0.6 * base  # four successors a word, where the unigram model sees forty
    assert got[150].score == got[151].score and got[152].score < 0


def test_probabilities_after_a_context_sum_to_one(spark):
    """Every known word and the unknown one after the same context: the model is a distribution."""
    train = ["a b a c", "b a a", "c c b a"]
    ends = ["", "a", "b", "c", "unknown"]
    docs = frame(spark, train + ends).withColumn("train", F.col("doc_id") < 3)
    rows = {r.doc_id: r for r in language_model.train_and_score(docs, "train", chunk_bytes=50, buckets=3).collect()}
    # P(first) P(end | first) = score; the first words' probabilities come from two texts that differ in it
    both = frame(spark, train + [f"{x} b" for x in "abc"] + [f"{x} b b" for x in "abc"]).withColumn("train", F.col("doc_id") < 3)
    again = {r.doc_id: r for r in language_model.train_and_score(both, "train", chunk_bytes=50, buckets=3).collect()}
    assert 10 ** rows[3].score < 1 and all(again[k].score < 0 for k in range(3, 9))
    empty = language_model.train_and_score(frame(spark, ["x"]).withColumn("train", F.lit(False)), "train").first()
    assert empty.train_tokens == 0 and empty.base_score == 0.0 and empty.score == 0.0
    assert language_model.train_and_score(frame(spark, []).withColumn("train", F.lit(True)), "train").count() == 0


def test_table_counts_are_not_capped_by_moves():
    """One draw seats every customer: a frequent dish has the tables it should have, as exact weights and a long plain chain say."""
    draws, exact = np.random.default_rng(5), language_model.stirling(0.75)
    for n, weight in ((40, 3.0), (256, 90.0), (256, 0.2)):
        mass = exact[n] + np.log(weight) * np.arange(1, n + 1)
        mass = np.exp(mass - mass.max()) / np.exp(mass - mass.max()).sum()
        mean = (mass * np.arange(1, n + 1)).sum()
        sd = math.sqrt((mass * np.arange(1, n + 1) ** 2).sum() - mean ** 2)
        for draw in (language_model.table_counts, language_model.many_tables):
            got = draw(np.full(4000, n), np.full(4000, weight), 0.75, draws)
            assert abs(got.mean() - mean) < 4 * sd / math.sqrt(4000) and abs(got.std() / sd - 1) < 0.1, (n, weight, draw)
    # of very many customers the tables besides the first are Poisson
    many = language_model.table_counts(np.full(300, 10**8), np.full(300, 3000.0), 0.75, draws)
    assert abs(many.mean() - 4001) < 4 * math.sqrt(4000 / 300)
    assert (language_model.table_counts(np.array([1, 2, 300, 10**7]), np.full(4, 1e-290), 0.75, draws) == 1).all()
    customers, prior, restaurant = np.array([60, 25, 8, 2, 1]), np.array([0.3, 0.3, 0.1, 0.01, 0.01]), np.zeros(5, np.int64)
    plain = language_model.Seating(customers, restaurant, prior, np.zeros(1, np.int64), 0.6, 1.0, 3)
    tables, ours, chain = np.ones(5), [], []
    for k in range(6000):
        tables = language_model.table_counts(customers, 0.6 * draws.standard_gamma(1.0 / 0.6 + tables.sum()) * prior, 0.6, draws)
        ours.append(tables)
        for _ in range(6):
            plain.step()
        chain.append(plain.tables.copy())
    assert np.allclose(np.mean(ours[500:], axis=0), np.mean(chain[500:], axis=0), rtol=0.06)


def test_gibbs_steps_keep_the_seating_whole():
    random_state = np.random.default_rng(1)
    customers = random_state.integers(1, 30, 200)
    restaurant = np.sort(random_state.integers(0, 20, 200))
    seating = language_model.Seating(customers, restaurant, np.full(200, 0.01), np.zeros(20, np.int64), 0.7, 1.0, 3)
    for _ in range(50):
        seating.step()
    moving = seating.moving
    assert (np.bincount(seating.dish, seating.size, len(moving)) == customers[moving]).all()
    assert (np.bincount(seating.dish, minlength=len(moving)) == seating.tables[moving]).all()
    assert (seating.tables >= 1).all() and (seating.tables <= customers).all() and seating.tables.sum() > 200
