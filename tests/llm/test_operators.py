"""The corpus operators against brute force, exact round trips and hostile inputs."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakefold.llm import common, decontaminate, fst, minhash, packing, quality, registered, sharding, simple8b, suffix_tree, toxicity, warc
from lakefold.llm.registered import table, tokenizer_path
from lakefold.llm.tokens import UnitEncoder
from lakefold.llm.words import NOT_ALNUM, Words, buffers, slices

from ..oracle import compare, duck

SF = "/root/testdata/sf0.001"
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

ODD = [
    "", " ", "\n\n", "a", "a b c", "a  b\n\n c\t", "x  y", "a   \nb <|endoftext|> c", "it's  don't 'll ΕΣ İx é ́a", "日本 語　テ", "\x1c a\x1db \x00 c",
    "naïve\r\n\r\nfoo   ", "<s>hello</s><unk><0x41>", "a" * 3000, "日本語" * 700, "\U0001f600" * 100 + "the", "the " * 3000, "=" * 900, "▁x ▁", "ab,cd;ef!\x01 gh \x01", "#*$ %&|<>",
]


def _documents(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    return rows + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(20_000, None), (20_001, rows[3][1]), rows[5]]


@pytest.fixture(scope="module")
def rows(spark):
    return _documents(spark)


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Documents with nulls, odd texts, copies, a repeated row and columns whose names clash with results."""
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("score", "kept", "n_words", "n_tokens", "ids", "shard", "slot", "start", "length", "rid", "print", "class_id", "leak", "toxicity", "row", "base"):
        frame = frame.withColumn(name, F.lit("own"))
    return frame.repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, SF, "labels")


@pytest.mark.parametrize("name", sorted(registered.ORACLES))
def test_sql_twin(spark, name):
    ok, note, _ = compare(spark, duck(SF), name, registered.QUERIES[name], registered.ORACLES[name], SF)
    assert ok, note


# 1 quality


def _base(text):
    words = WORD.findall(text or "")
    triples = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    at = {i + k for i in range(len(words) - 2) if triples[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(at) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(at), failed


def test_quality_base_rules(spark, docs, rows, labels):
    found = quality.score_documents(docs, labels).collect()
    expected = sorted((i, *_base(t)) for i, t in rows)
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found) == expected
    assert all(r.ids == "own" for r in found)


def test_quality_score_is_the_log_ratio(spark):
    """The score from counts kept in dictionaries, with Spark's own hash taken word by word."""
    texts = [(i, f"good text number {i % 3} " + "alpha beta gamma delta " * (1 + i % 4)) for i in range(8)] + [(8 + i, "$$$ JUNK JUNK %%% " * (2 + i)) for i in range(6)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 8)) for i in range(14)], "doc_id long, quality int")
    sample = {r[0]: (r[1], r[2]) for r in quality.trusted_sample(labels, 100).collect()}
    grams = {i: r for i, r in frame.transform(quality.with_words).select("doc_id", quality._ngrams(F.col("__words"), 512)).collect()}
    raw, target = Counter(), Counter()
    for i, g in grams.items():
        raw.update(g)
        if sample[i] == (1, 0):
            target.update(g)
    n, m = sum(raw.values()), sum(target.values())
    share = lambda b: (raw[b] + 1) / (n + 512)
    weight = lambda b: math.log((target[b] + 512 * share(b)) / (m + 512)) - math.log(share(b))
    for r in quality.score_documents(frame, labels, buckets=512).collect():
        assert r.score == pytest.approx(sum(map(weight, grams[r.doc_id])) / len(grams[r.doc_id]))


def test_quality_without_labels_or_rows(spark, docs, labels):
    assert quality.score_documents(docs.limit(0), labels).count() == 0
    kept = quality.score_documents(docs, labels.limit(0)).select("base_failed", "kept").collect()
    assert all(r.kept != r.base_failed for r in kept)


def test_quality_takes_every_label(spark, docs, labels):
    """More labels than the former sample; the threshold against a walk over all scores."""
    many = spark.range(25_000).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("quality"))
    assert quality.trusted_sample(many).count() == 25_000
    rows = [(float((i * 7919) % 501) / 97 + (0.7 if i % 3 == 0 else 0.0), int(i % 3 == 0), ["w"]) for i in range(400)]
    good, bad = ([s for s, t, _ in rows if t == k] for k in (1, 0))
    values = sorted({*good, *bad})
    errors = [sum(g < v for g in good) / len(good) + 1 - sum(b < v for b in bad) / len(bad) for v in values]
    k = errors.index(min(errors))
    expected = (values[k] + values[k - 1]) / 2 if k else values[k]
    assert quality._threshold(spark.createDataFrame(rows, "score double, __trusted int, __words array<string>")) == pytest.approx(expected)


# 2 toxicity


def test_folding():
    assert toxicity.fold_text("1d10t іdіot, IDIOT! 2024 idiot$$$ ｉｄiot").split() == ["idiot", "idiot", "idiot", "idiot", "idiot"]


def test_substituted_last_letters(spark):
    lexicon = toxicity.Lexicon({"shit": 2.0, "idiot": 2.0, "hate": 2.0, "ass": 2.0}, ("ass kicking",), 0.1)
    texts = ["5h17", "idi07", "h4t3", "idiot$$$", "1d107!!!", "idi07$$$", "455", "2024 70 5", "a55 kicking", "idi07 idiot", "a555555", "idiot5 h4t3"]
    found = toxicity.score_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), lexicon).orderBy("doc_id").collect()
    assert [r.toxicity.n_matches for r in found] == [1, 1, 1, 1, 1, 1, 0, 0, 0, 2, 1, 2]


def test_words_of_few_toxic_texts_enter_the_lexicon(spark):
    rows = [(i, f"plain words of text {i} " + ("zorkish" if i < 19 else "blagging"), 1) for i in range(2000)] + [(i, f"plain words of text {i}", 0) for i in range(2000, 4000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = toxicity.fit(frame, frame.select("doc_id", "toxic")).entries
    assert any("zorkish".startswith(e.rstrip("*")) for e in found) and not any("plain".startswith(e.rstrip("*")) for e in found)


def test_lexicon_matching_and_exceptions(spark):
    lexicon = toxicity.Lexicon({"trash": 2.0, "idio*": 3.0}, ("trash can",), 0.1)
    texts = ["", None, "the trash can is full", "you trash", "idi0tic trash", "trashy", "can trash"]
    found = toxicity.score_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), lexicon).orderBy("doc_id").collect()
    assert [r.toxicity.n_matches for r in found] == [0, 0, 0, 1, 2, 0, 1]
    assert all(0 <= r.toxicity.score < 1 for r in found) and found[0].toxicity.score == 0
    raw = 5.0 / 12
    assert found[4].toxicity.score == pytest.approx(raw / (raw + 0.1))


def test_toxicity_held_out(spark):
    truth = {r.doc_id: r.toxic for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    scored = registered.QUERIES["op2_toxicity"](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in scored if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.9 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in scored)


def test_toxicity_odd_inputs(spark, docs, rows, labels):
    scored = toxicity.score_texts(docs, toxicity.fit(docs, labels))
    assert scored.count() == len(rows) and scored.where("toxicity.score IS NULL").count() == 0
    assert toxicity.fit(docs, labels.limit(0)).entries == {}
    assert toxicity.score_texts(docs.limit(0), toxicity.Lexicon()).count() == 0


# 3 web archives


def test_archives(spark):
    big, other = "x" * 2000, "é" * 600
    pages = [(1, "http://a/1", big), (2, None, big), (7, "http://a/\r\n7", big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (8, "u", other), (9, "u", other), (10, "u", "\r\n\r\n" + big), (9, "u", other)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("own"))
    manifest = warc.write_archives(frame.repartition(4))
    found = warc.read_archives(manifest).collect()
    top = {big: 7, other: 9}
    want = sorted((i, "revisit" if h in top and i < top[h] else "response", hashlib.sha1((h or "").encode()).hexdigest(), len((h or "").encode()), top[h] if h in top and i < top[h] else None) for i, _, h in pages)
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted(((r.page_id, r.record_type, r.payload_digest, r.payload_bytes, r.refers_to) for r in found), key=key) == sorted(want, key=key)
    assert all(bytes(r.payload) == (dict((i, h) for i, _, h in pages)[r.page_id] or "").encode() for r in found if r.record_type == "response")
    assert sum(r.records for r in manifest.collect()) == len(pages)
    assert warc.read_archives(warc.write_archives(frame.limit(0))).count() == 0


# 4 packing


def test_packing_texts(spark, docs, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(library.encode(t or "", add_special_tokens=False).ids + [0])
    pieces = packing.pack_texts(docs, tokenizer_path("byte_bpe_50k.json"), end=0).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append((p.start, np.frombuffer(p.ids, "<u4").tolist(), p.doc_tokens))
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for i, texts in want.items():
        copies = len(texts)
        got = sum((ids for _, ids, _ in sorted(by_doc[i])[::copies]), []) if copies > 1 else sum((ids for _, ids, _ in sorted(by_doc[i])), [])
        assert got == texts[0] or copies > 1 and sum(len(x[1]) for x in by_doc[i]) == copies * len(texts[0])
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 1024
    sizes = [sum(n for _, n in parts) for parts in by_sequence.values()]
    assert sum(s < 1000 for s in sizes) <= 3  # one a partition


def test_packing_examples_keeps_all_limits(spark):
    rng = np.random.default_rng(7)
    need = [(i, int(t), int(rng.integers(0, t + 1))) for i, t in enumerate(rng.integers(0, 900, 500))] + [(500, 5000, 1), (501, None, None)]
    packed = packing.pack_examples(spark.createDataFrame(need, "id long, tokens long, loss_tokens long").coalesce(1), limits=(1024, 6, 700)).collect()
    groups = defaultdict(list)
    for r in packed:
        groups[r.sequence_id].append(r)
    assert [r.id for r in groups.pop(None)] == [r[0] for r in need if (r[1] or 0) > 1024 or (r[2] or 0) > 700]
    for g in groups.values():
        assert sum(r.tokens or 0 for r in g) <= 1024 and len(g) <= 6 and sum(r.loss_tokens or 0 for r in g) <= 700
        g.sort(key=lambda r: r.segment)
        assert [r.offset for r in g] == [sum((x.tokens or 0) for x in g[:k]) for k in range(len(g))]
    fits = [r for r in need if (r[1] or 0) <= 1024 and (r[2] or 0) <= 700]
    least = max(sum(r[1] or 0 for r in fits) / 1024, len(fits) / 6, sum(r[2] or 0 for r in fits) / 700)
    assert len(groups) <= 1.1 * least + 1


# 5 near duplicates


def _classes(rows):
    shingles = {}
    for i, (_, t) in enumerate(rows):
        w = ALNUM.findall((t or "").translate(LOWER))
        k = min(5, len(w))
        shingles[i] = Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else Counter({t: 1} if t else {})
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in shingles:
        for b in shingles:
            if a < b and shingles[a] and shingles[b]:
                common = sum((shingles[a] & shingles[b]).values())
                if common and common >= 0.8 * sum((shingles[a] | shingles[b]).values()):
                    parent[find(a)] = find(b)
    groups = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        groups[find(i)].append(key)
    return sorted(sorted(g) for g in groups.values())


def _near(rng, words, share):
    out = list(words)
    for p in rng.choice(len(out), max(1, int(share * len(out))), replace=False):
        out[p] = f"edit{rng.integers(1 << 40)}"
    return " ".join(out)


def test_near_duplicates_against_brute_force(spark, docs, rows):
    rng = np.random.default_rng(3)
    body = [f"w{rng.integers(3000)}" for _ in range(400)]
    more = [(30_000 + i, _near(rng, body, 0.01)) for i in range(12)] + [(31_000 + i, _near(rng, body, 0.3)) for i in range(6)]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")).withColumn("rid", F.lit(1))
    found = defaultdict(list)
    for r in minhash.near_duplicates(frame).collect():
        found[r.class_id].append(r.doc_id)
    assert all(c == min(g) for c, g in found.items())
    assert sorted(sorted(g) for g in found.values()) == _classes(rows + more)
    assert minhash.near_duplicates(frame.limit(0)).count() == 0


def test_links_between_texts_that_miss_the_bucket_leader(spark):
    """A chain: neighbours are alike, its ends are not; all of it is one class."""
    rng = np.random.default_rng(5)
    words = [f"c{i}" for i in range(300)]
    chain = []
    for i in range(40):
        chain.append((i, " ".join(words)))
        for p in rng.choice(300, 3, replace=False):
            words[p] = f"n{i}x{p}"
    found = minhash.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string")).collect()
    assert len({r.class_id for r in found}) == 1


def test_small_groups_inside_a_large_bucket(spark):
    """Texts of fixed sections and 16 in two wordings: all shingles are frequent, each text is alike to its partner only."""
    rng = np.random.default_rng(11)
    codes, texts = [], []
    while len(codes) < 200:
        code = rng.integers(0, 2, 16)
        if all((code != c).sum() >= 4 for c in codes):
            codes.append(code)
            own = [f"s{k}v{v}w{i}" for k, v in enumerate([*code, *[2] * 12]) for i in range(20)]
            texts += [_near(rng, own, 0.001), _near(rng, own, 0.001)]
    places = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in map(str.split, texts)]
    number = {g: i for i, g in enumerate(set().union(*places))}
    matrix = np.zeros((len(texts), len(number)), np.float32)
    for i, own in enumerate(places):
        matrix[i, [number[g] for g in own]] = 1
    common, size = matrix @ matrix.T, matrix.sum(1)
    a, b = np.nonzero(common >= 0.8 * (size[:, None] + size - common))
    assert sorted(zip(a.tolist(), b.tolist())) == sorted((i, j) for i in range(len(texts)) for j in (i, i ^ 1))
    found = dict(minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert found == {i: i & ~1 for i in range(len(texts))}


def test_meetings_of_a_large_group(spark):
    """A shingle of 300 texts: few pairs a level while links are found, and no pair that stays apart is left out."""
    rng = random.Random(5)
    rows = [(7, i, 10.0, 10.0, 0, rng.randrange(1 << 30), 0 if i % 37 == 0 else 1 if i % 5 == 0 else 2) for i in range(300)]
    rows = sorted(rows, key=lambda r: r[6])
    rows = [(*r[:5], place, r[6]) for r, place in zip(rows, sorted(r[5] for r in rows))]  # levels follow places
    entries = spark.createDataFrame(rows, "code long, rid long, weight double, rest double, most long, place long, level int")
    root, met, listed = {i: 0 if i < 120 else i for i in range(300)}, set(), []
    for level in range(3):
        roots = spark.createDataFrame(list(root.items()), "rid long, root long")
        pairs = {(r.a, r.b) for r in minhash.meetings(entries, roots, level, 0.8).collect()}
        assert all(root[a] != root[b] for a, b in pairs)
        met |= {frozenset(p) for p in pairs}
        listed.append(len(pairs))
        for i in range(120, 290):  # most come into the large component, some into one beside it
            if i % 3 == level or level == 1:
                root[i] = 290 if i % 19 == 0 else 0
    assert listed[0] <= 180 * 9 and sum(listed) < 37_710 / 2  # pairs of different components in the beginning
    assert {frozenset((a, b)) for a in root for b in root if root[a] != root[b]} <= met


def test_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, 101), (105, 101)], "a long, b long")
    roots = dict(minhash.components(edges).collect())
    assert roots == {i: 0 for i in range(61)} | {100: 100, 101: 100, 105: 100}


def test_keep_one(spark, docs, rows):
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({min(g) for g in _classes(rows)})


# 6 token-id files


@pytest.mark.parametrize("high", [1, 2, 300, 50_000, 1 << 40, (1 << 64) - 1])
def test_simple8b_round_trip(high):
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 1023, 1024, 1025, 20_000):
        ids = rng.integers(0, high, n, dtype=np.uint64)
        ids[n // 3 : n // 2] = 0
        words, escapes, first = simple8b.encode(ids)
        assert (simple8b.decode(words, escapes, first, n) == ids).all()


def test_id_files(spark, docs, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, start, ids))
        start += len(ids)
    manifest = simple8b.write_ids(docs, tokenizer_path("word_bpe_49k.json"), keeps_blanks=False, lower=True)
    found = sorted((r.doc_id, r.start, r.ids) for r in simple8b.read_ids(manifest, with_ids=True).collect())
    assert found == want
    assert simple8b.read_ids(simple8b.write_ids(docs.limit(0), tokenizer_path("word_bpe_49k.json"), keeps_blanks=False, lower=True)).count() == 0


@pytest.mark.parametrize("name,keeps,lower", [("byte_bpe_50k.json", True, False), ("word_bpe_49k.json", False, True)])
def test_units_give_the_library_ids(name, keeps, lower):
    encoder = UnitEncoder(tokenizer_path(name), keeps, lower)
    found = [ids[b[i] : b[i + 1]].tolist() for row, last, ids, b in encoder.encode(pa.array([*ODD, None])) for i in range(last - row)]
    assert found == [e.ids for e in encoder.tokenizer.encode_batch([*ODD, ""], add_special_tokens=False)]


# 7 decontamination


def test_decontamination(spark, docs, rows):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    tests = spark.createDataFrame([(1, passage), (2, "Tiny item"), (3, "..."), (4, None), (None, passage), (1, passage)], "item_id long, text string")
    extra = [(40_000, f"before, {passage.upper()}! after"), (40_001, "a TINY--item here"), (40_002, passage), (40_003, "two three four five six seven eight nine ten")]
    frame = docs.select("doc_id", "text", "leak").union(spark.createDataFrame([(*r, "own") for r in extra], "doc_id long, text string, leak string"))
    for size in (32 << 20, 16):
        found = {r.doc_id: r.leak for r in decontaminate.find_test_windows(frame, tests, block_bytes=size).collect()}
        assert (found[40_000].n_hit, found[40_000].items, found[40_000].clean_text) == (12, ["1"], "before, ! after")
        assert (found[40_001].n_hit, found[40_001].items, found[40_001].clean_text) == (2, ["2"], "a  here")
        assert found[40_003].n_hit == 0 and found[20_000].n_words == 0
        assert all(found[i].n_words == len(ALNUM.findall((t or "").translate(LOWER))) for i, t in rows)
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(frame, tests).collect()}
    assert 40_002 not in cut and cut[40_000] == "before, ! after" and cut[20_000] is None
    assert decontaminate.decontaminate(frame, tests, mode="documents").count() == frame.count() - 3
    assert decontaminate.decontaminate(frame, tests.limit(0)).count() == frame.count()


# 8 token counts


def test_transducer_counts(spark, docs, rows):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    counted = fst.count_tokens(docs, tokenizer_path("piece_bpe_32k.model")).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in counted) == sorted((i, len(library.encode(t or ""))) for i, t in rows)


def test_chunk_borders_do_not_matter():
    machine = fst.Transducer.of(tokenizer_path("piece_bpe_32k.model"))
    text = np.array([fst._BREAK, *map(ord, "▁" + "日本語テキストinternationalization" * 60)])
    assert machine.deltas(text, lanes=1).sum() == machine.deltas(text, lanes=37).sum() == machine.deltas(text, lanes=4096).sum()


# 9 sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(n):
    assert sorted(sharding.permute(np.arange(n), n, 9).tolist()) == list(range(n))


def test_shards(spark, docs, rows, tmp_path):
    placed = sharding.shard_rows(docs, 7, order=["doc_id", "text"], seed=4).collect()
    by_shard = defaultdict(list)
    for r in placed:
        by_shard[r.shard].append(r.slot)
    assert len(placed) == len(rows) and all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    assert all(7 * r.slot + r.shard == p for r, p in zip(placed, sharding.permute(np.array([r.row_number for r in placed]), len(rows), 4)))
    assert sharding.shard_rows(docs.limit(0), 7, order=["doc_id"]).count() == 0


def test_written_shards(spark, tmp_path):
    rows = [(None, "x"), (None, "y"), (None, None), *[(1, "same")] * 5, (1, "other"), *((i, f"text {i}") for i in range(2, 40))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    match = {"size": F.octet_length(text), "text_crc32": F.crc32(text)}
    ids = frame.select("doc_id", *(c.alias(n) for n, c in match.items()))
    placed = corpus_pipeline.stored(sharding.shard_rows(ids, 3, order=["doc_id", "size", "text_crc32"], seed=4), "placed")
    for k, given in enumerate((match, None)):
        sharding.write_shards(frame, placed, f"{tmp_path}/{k}", key="doc_id", match=given)
        written = spark.read.parquet(f"{tmp_path}/{k}").collect()
        text_key = lambda r: tuple("" if v is None else str(v) for v in r)
        assert sorted(((r.doc_id, r.text) for r in written), key=text_key) == sorted(rows, key=text_key)
        assert sorted((r.shard, r.slot, r.doc_id or 0) for r in written) == sorted((r.shard, r.slot, r.doc_id or 0) for r in placed.collect())
    with pytest.raises(ValueError):
        sharding.write_shards(frame.where("doc_id > 1"), placed, f"{tmp_path}/2", key="doc_id")


# 10 suffix tree


def test_suffix_tree_against_dictionaries(spark, rows):
    texts = [(i, (t or "").translate(LOWER)) for i, t in rows[:150]] + [(50_000 + i, f"alpha beta gamma {i % 3} alpha beta delta") for i in range(60)] + [(60_000, None)]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    train = F.col("doc_id") % 10 != 0
    least, divergence = 2e-3, 0.05
    found = {r.doc_id: r for r in suffix_tree.score_texts(frame, train, least=least, divergence=divergence).collect()}
    tokens = {i: [*WORD.findall(t or ""), "\n"] for i, t in texts}
    counts, grams = Counter(), [Counter(), Counter()]
    for i, t in tokens.items():
        if i % 10:
            counts.update(t)
    n, v, once = sum(counts.values()), len(counts), sum(c == 1 for c in counts.values())
    bound = max(2.0, least * n)
    listed = {w for w, c in counts.items() if c >= bound}
    for i, t in tokens.items():
        if i % 10:
            line = ["\n", *t]
            grams[0].update(p for p in zip(line, line[1:]) if set(p) <= listed)
    grams[0] = Counter({g: c for g, c in grams[0].items() if c >= bound})
    # slices are one stream, so a context of two words may reach over the end of the text before
    root = lambda w: counts[w] / (n + once) if counts[w] else once / (n + once)
    kept = {}
    for context in {g[0] for g in grams[0]}:
        nexts = {g[1]: c for g, c in grams[0].items() if g[0] == context}
        total = counts[context]
        left = (total - sum(nexts.values()) + len(nexts)) / (total + len(nexts))
        dist = {w: c / (total + len(nexts)) + left * root(w) for w, c in nexts.items()}
        p, q = sum(dist.values()), sum(map(root, dist))
        if sum(d * math.log(d / root(w)) for w, d in dist.items()) + (1 - p) * math.log((1 - p) / (1 - q)) >= divergence:
            kept[context] = (dist, left)
    assert kept
    for i, t in tokens.items():
        r = found[i]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(counts[w] > 0 for w in t), n) and r.base_score == pytest.approx(base)
    tree, _, _ = suffix_tree.fit(frame.where(train).select("text"), suffix_tree._counted(frame.where(train).select("text"), lambda s: s[1:]), least=least, divergence=divergence)
    assert len(tree.levels[0][0]) == len(kept)
    bigram = suffix_tree.SuffixTree(tree.known, tree.totals, n, once)
    bigram.levels = tree.levels[:1]
    line = ["\n", *tokens[50_001]]
    stream, _ = suffix_tree.tokens(Words(*buffers(pa.array([" ".join(line[1:-1])]))))
    number = suffix_tree._numbers(tree.known, stream)
    want = [kept[a][0].get(b, kept[a][1] * root(b)) if a in kept else root(b) for a, b in zip(line, line[1:])]
    assert np.allclose(bigram.probabilities(number, np.array([root(b) for b in line[1:]])), want)


def test_suffix_tree_sums_to_one(spark, rows):
    frame = spark.createDataFrame([(i, t) for i, t in rows[:100]] + [(i, "alpha beta gamma alpha beta delta") for i in range(50)], "doc_id long, text string").select("text")
    vocabulary = suffix_tree._counted(frame, lambda s: s[1:])
    tree, total, _ = suffix_tree.fit(frame, vocabulary, least=1e-3)
    rest = 1 - tree.root.sum()  # the words that are not listed, known or not
    assert len(tree.levels) == 2 and all(len(level[0]) for level in tree.levels)
    for depth, (contexts, *_) in enumerate(tree.levels):
        for code in contexts[:20].tolist():
            history = [(code >> (20 * k)) & ((1 << 20) - 1) for k in range(depth, -1, -1)]
            last = len(history)
            mass = sum(tree.probabilities(np.array([*history, w]), np.concatenate([np.ones(last - 1), [tree.root[w]]]))[-1] for w in range(len(tree.known)))
            factor = tree.probabilities(np.array([*history, -1]), np.ones(last))[-1]
            assert mass + factor * rest == pytest.approx(1)


def test_suffix_tree_beats_the_unigram_base(spark):
    scored = [r for r in registered.QUERIES["op10_suffix_tree"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in scored) > sum(r.base_score for r in scored)


def test_suffix_tree_scores_do_not_depend_on_the_row_before(spark):
    texts = [(i, "red alpha beta omega" if i % 2 else "blue gamma delta psi") for i in range(400)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    orders = [frame.coalesce(1), frame.orderBy(F.col("doc_id") % 2, "doc_id").coalesce(1), frame.repartition(5)]
    scores = [dict(suffix_tree.score_texts(f, F.lit(True)).select("doc_id", "score").collect()) for f in orders]
    assert scores[1] == pytest.approx(scores[0], abs=1e-6) and scores[2] == pytest.approx(scores[0], abs=1e-6)
    assert len({round(v, 6) for v in scores[0].values()}) <= 2


def test_suffix_tree_without_training_rows(spark):
    frame = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    found = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.score, 9)) for r in suffix_tree.score_texts(frame, F.lit(False)).collect())
    assert found == [(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)]


# helpers and the pipeline


def test_words_match_the_patterns():
    texts = [*ODD, None, "Ab c\tD\x0be"]
    data, offsets = buffers(pa.array(texts))
    for a, b in slices(offsets, 64):
        words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], NOT_ALNUM)
        for r in range(a, b):
            own = [words.text(w).decode() for w in range(words.first[r - a], words.first[r - a + 1])]
            assert own == ALNUM.findall((texts[r] or "").translate(LOWER))


def test_pipeline_stages(spark):
    """Each stage on its predecessor's rows, against the operators' own results."""
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    names, sizes = docs.columns, [docs.count()]
    before = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = corpus_pipeline.stored(stage(spark, before, sf), "test-stage")
        if k < 4:
            assert after.columns == names
            assert after.join(before, "doc_id", "left_anti").count() == 0
            sizes.append(after.count())
            if k != 3:  # texts change only where test passages are cut
                assert after.exceptAll(before).count() == 0
            before = after
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] >= sizes[4] > 0
    labels = {r.doc_id: (r.quality, r.toxic) for r in table(spark, sf, "labels").collect()}
    kept = {r.doc_id for r in before.select("doc_id").collect()}
    assert not any(labels.get(i, (1, 0))[0] == 0 for i in kept)
    assert sum(labels.get(i, (1, 0))[1] for i in kept) <= 15
    again = decontaminate.find_test_windows(before, table(spark, sf, "benchmark"))
    assert again.where("leak.n_hit > 0").count() == 0
    assert minhash.near_duplicates(corpus_pipeline.near_dedup(spark, docs, sf)).where("doc_id <> class_id").count() == 0
    ids = {r.doc_id for r in after.select("doc_id").distinct().collect()}
    assert ids == kept


def test_stages_take_odd_documents(spark, rows):
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, frame, SF).columns == frame.columns
        assert stage(spark, frame.limit(0), SF).count() == 0
        assert stage(spark, frame, SF).count() > 0
    assert os.path.isdir(SF)


def test_keep_one_tells_texts_of_one_id_apart(spark):
    """Two texts share an id, one is a copy of another document: the copy goes, the other text stays."""
    words = lambda tag: " ".join(f"{tag}{i}" for i in range(40))
    rows = [(3, words("a"), "x"), (7, words("a"), "y"), (7, words("b"), "z"), (7, words("b"), "z"), (9, words("c"), "x"), (None, words("a"), "n")]
    kept = minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((str(r.doc_id), r.text[0], r.source) for r in kept) == [("3", "a", "x"), ("7", "b", "z"), ("9", "c", "x"), ("None", "a", "n")]


def test_labels_meet_their_texts_without_moving_the_others(spark):
    """A large label table made the join shuffle every text."""
    rows = spark.range(60_000).select("id", F.concat(F.lit("t"), "id").alias("text"))
    keys = rows.where("id % 7 = 0").select(F.col("id").alias("k")).union(spark.sql("SELECT CAST(NULL AS LONG)"))
    left = {r.id for r in common.may_match(rows, "id", keys).collect()}
    assert left.issuperset(range(0, 60_000, 7)) and len(left) < 60_000 // 7 + 60


def test_only_wanted_texts_are_shuffled_for_near_copies(spark):
    """The exchange of the texts lies above the filter on the bitmaps, also for keys that are structs."""
    rows = spark.range(3000).select(F.struct("id", F.xxhash64("id").alias("print")).alias("own"), F.concat(F.lit("t"), "id").alias("body"))
    wanted = common.stored(rows.where("own.id % 10 = 0").select(F.col("own").alias("key")), "wanted")
    found = minhash.texts_of(rows, wanted, "own", "body")
    assert {r.key.id: r.text for r in found.collect()} == {i: f"t{i}" for i in range(0, 3000, 10)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and plan.index("strategy=merge") < plan.index("strategy=broadcast")
