"""Lexical search, best-fit packing and token alignment against brute force: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import alignment, binpack, oracles, wavelet

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
LONG = "alpha beta gamma, delta's 4th <|endoftext|> Ünïcode " * 900
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog; it's 42 o'clock."),
    (2, "The quick brown fox jumps over the lazy dog; it's 42 o'clock."),
    (3, None),
    (4, ""),
    (5, "Äpfel und BIRNEN\tliegen im Korb\r\n\r\n日本語のテキスト 🙂🙂"),
    (5, "Äpfel und BIRNEN\tliegen im Korb\r\n\r\n日本語のテキスト 🙂🙂"),
    (6, LONG),
    (7, "   \n \t"),
    (None, "A row without an id: quick quick QUICK fox."),
    (8, "lower▁line marks a space for one of them"),
    (9, "éclair Straße İstanbul ΣΑΣ \x00 \x01 ***&&& <|endoftext|>"),
    (10, " " * 3000 + "x"),
]
SCHEMA = "doc_id long, text string, part string, nth string, `rank` string, links string, item string, term string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, *"abcdef") for i, t in ROWS], SCHEMA).repartition(3).cache()


# --- search ----------------------------------------------------------------------


def by_hand(rows, asked, k=10):
    """Every document scored for every query."""
    found = [(i, Counter(w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(wavelet.TERM, t or ""))) for i, t in rows]
    found = [(i, c) for i, c in found if c]
    n, total = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in asked:
        terms = {w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(wavelet.TERM, text or "")}
        scores = []
        for i, c in found:
            m = 10 + 90 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return out


def searched(docs, asked, shard_terms, k=10):
    n, terms = wavelet.corpus_size(docs)
    index = wavelet.index_shards(docs, n, max(1, terms), shard_terms=shard_terms)
    return [tuple(r) for r in wavelet.search(index, asked, n, k).orderBy("item_id", "rank").collect()]


ASKED = [(1, "quick FOX, quick!"), (2, None), (3, ""), (4, "nowhere"), (5, "日本語のテキスト alpha"), (6, "the lazy dog of İstanbul"), (7, "x 🙂🙂")]


@pytest.mark.parametrize("shard_terms", [1, 40, 10_000])
def test_search_equals_brute_force(spark, docs, shard_terms):
    asked = spark.createDataFrame(ASKED, "item_id long, text string")
    assert searched(docs, asked, shard_terms) == by_hand(ROWS, ASKED)
    assert searched(docs.limit(0), asked, shard_terms) == []
    assert searched(docs, asked.limit(0), shard_terms) == []


def test_search_on_many_documents_with_copies_and_ties(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(60)], k=rng.randint(1, 30))) for _ in range(300)]
    rows = [(k, texts[min(k, 299)]) for k in range(500)]  # 200 copies of the last one
    rng.shuffle(rows)
    asked = [(q, " ".join(rng.sample(vocabulary, 8))) for q in range(12)] + [(12, texts[299])]
    table, items = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(asked, "item_id long, text string")
    expected = by_hand(rows, asked)
    for shard_terms in (150, 100_000):
        assert searched(table, items, shard_terms) == expected
    n, terms = wavelet.corpus_size(table)
    shards = [wavelet.Shard(r.asDict()) for r in wavelet.index_shards(table.coalesce(1), n, terms).collect()]
    weights = {b"w1": 7, b"w40": 900, b"absent": 3, b"w3": 0}
    full = shards[0].top(weights, 500, batch=1000)
    assert shards[0].top(weights, 10, batch=1) == shards[0].top(weights, 10, batch=16) == full[:10]


def test_search_in_blocks_and_from_the_stored_index(spark, docs, tmp_path):
    asked = spark.createDataFrame(ASKED, "item_id long, text string")
    n, terms = wavelet.corpus_size(docs)
    index = wavelet.store_index(wavelet.index_shards(docs, n, terms, shard_terms=30), str(tmp_path / "index"))
    got = [tuple(r) for r in wavelet.search(index, asked, n, most_queries=2).orderBy("item_id", "rank").collect()]
    assert got == by_hand(ROWS, ASKED)


def test_search_sql(spark, docs):
    documents, benchmark = docs.select("doc_id", "text").toPandas().astype(object), spark.createDataFrame(ASKED, "item_id long, text string").toPandas()
    documents = documents.where(documents.notna(), None)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", documents.values.tolist())
    con.register("benchmark", benchmark)
    got = con.sql(f"SELECT item_id, rank, doc_id, score FROM ({oracles.OP11}) ORDER BY item_id, rank").fetchall()
    assert got == by_hand(ROWS, ASKED)


def test_term_counts_agree_in_the_jvm_and_in_the_shards(docs):
    n, terms = wavelet.corpus_size(docs)
    each = [len(wavelet.terms_of((t or "").encode())) for _, t in ROWS]
    assert (n, terms) == (sum(k > 0 for k in each), sum(each))


# --- best-fit packing ----------------------------------------------------------------


def test_word_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    full, encode = Tokenizer.from_file(WORD), binpack.WordEncoder(WORD, limit=50)
    texts = [t or "" for _, t in ROWS] + ["don't WON'T we'll, x86-64 $%&/() <| <|startoftext|>a ß×÷µ", "a" * 500 + "!" * 300]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == full.encode(text, add_special_tokens=False).ids
    whole = [t.removesuffix("</w>") for t in full.get_vocab() if t.endswith("</w>") and t.isascii()]
    fast = binpack.WordEncoder(WORD)
    for at in range(0, len(whole), 500):
        text = " ".join(whole[at : at + 500])
        assert np.frombuffer(fast(text), "<u4").tolist() == full.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seq_len", [16, 2048])
def test_packing_holds_every_id_once(docs, seq_len):
    from tokenizers import Tokenizer

    got = binpack.pack_best_fit(docs, WORD, end_id=0, seq_len=seq_len).collect()
    full, ids = Tokenizer.from_file(WORD), {}
    for i, t in ROWS:
        ids.setdefault(i, []).append(full.encode(t or "", add_special_tokens=False).ids + [0])
    pieces = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    expected = Counter((i, p, s, len(x[s : s + seq_len]), zlib.crc32(np.array(x[s : s + seq_len], "<u4").tobytes())) for i, xs in ids.items() for x in xs for p, s in enumerate(range(0, len(x), seq_len)))
    assert pieces == expected
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= seq_len
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // seq_len) + 1
    assert binpack.pack_best_fit(docs.limit(0), WORD).count() == 0


def fewest(lengths, capacity):
    """The number of bins by trying all assignments."""
    best = len(lengths)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= lengths[k]:
                go(k + 1, rooms[:j] + [rooms[j] - lengths[k]] + rooms[j + 1 :])
        go(k + 1, [*rooms, capacity - lengths[k]])

    go(0, [])
    return best


def test_bins_against_all_assignments():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.randint(5, 30)
        lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 8))), reverse=True)
        made = binpack.combinations(dict(Counter(lengths)), capacity)
        used = Counter()
        for chosen, times in made:
            assert sum(n * k for n, k in chosen.items()) <= capacity
            for n, k in chosen.items():
                used[n] += k * times
        assert used == Counter(lengths)
        assert sum(t for _, t in made) <= fewest(lengths, capacity) + 1


def test_fullest_is_the_largest_sum():
    rng = random.Random(4)
    for _ in range(300):
        counts = {rng.randint(1, 20): rng.randint(1, 4) for _ in range(rng.randint(1, 4))}
        capacity = rng.randint(0, 60)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        chosen = binpack.fullest(counts, capacity)
        assert sum(n * k for n, k in chosen.items()) == max(s for s in sums if s <= capacity)
        assert all(k <= counts[n] for n, k in chosen.items())


def test_many_items_of_one_length_take_few_searches():
    made = binpack.combinations({n: 10**9 + n for n in range(1, 2049)}, 2048)
    assert len(made) < 20_000
    total = sum(n * (10**9 + n) for n in range(1, 2049))
    assert sum(t for _, t in made) <= (total / 2048) * (1 + 1e-6)


# --- alignment -----------------------------------------------------------------------


def aligned_by_hand(rows):
    """Offsets of every token, groups cut where both end, links counted one by one."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(BYTE), SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    back = {c: k for k, c in binpack.byte_letters().items()}
    out, counts, by_doc = [], Counter(), []
    for i, text in rows:
        raw = (" " + (text or "")).encode()
        ta = [(k, bytes(back[c] for c in a.id_to_token(k))) for k in a.encode(" " + (text or ""), add_special_tokens=False).ids] if text else []
        tb = [(k, bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()) for k in b.encode(text)] if text else []
        if b"".join(x for _, x in ta) != raw or b"".join(x for _, x in tb) != raw:
            by_doc.append((i, 0, 0, 0, [], ""))
            continue
        ends = []
        for tokens in (ta, tb):
            at, own = 0, []
            for _, x in tokens:
                at += len(x)
                own.append(at)
            ends.append(own)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        links = [(ta[j][0], tb[k][0]) for j, x in enumerate(ends[0]) for k, y in enumerate(ends[1]) if x == y] if len(ta) < 3000 else [(ta[j][0], tb[ends[1].index(x)][0]) for j, x in enumerate(ends[0]) if x in set(ends[1])]
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(t[0]) for t, e in zip(tokens, own) if low < e <= cut) for tokens, own in zip((ta, tb), ends)))
            low = cut
        counts.update(links)
        by_doc.append((i, len(ta), len(tb), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    highest = Counter()
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    for i, na, nb, ng, links, digest in by_doc:
        out.append((i, na, nb, ng, len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return out


def test_alignment_equals_brute_force(docs):
    rows = [(i, t if i != 6 else LONG[:4000]) for i, t in ROWS]
    short = docs.withColumn("text", F.when(F.col("doc_id") == 6, F.lit(LONG[:4000])).otherwise(F.col("text")))
    got = alignment.align_and_count(short, BYTE, PIECE)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    key = lambda r: (r[0] is None, r[0] or 0, r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(aligned_by_hand(rows), key=key)
    assert alignment.align_and_count(docs.limit(0), BYTE, PIECE).count() == 0


def test_alignment_does_not_depend_on_slices(docs):
    whole = {(r.doc_id, r.groups_sha256, tuple(r.links)) for r in alignment.align(docs, BYTE, PIECE).collect()}
    cut = {(r.doc_id, r.groups_sha256, tuple(r.links)) for r in alignment.align(docs, BYTE, PIECE, slice_chars=1).collect()}
    assert whole == cut


def test_interval_index():
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randint(1, 30)
        cut = lambda: np.array(sorted({*rng.sample(range(1, n), rng.randint(0, n - 1)), n}))
        a, b = cut(), cut()
        first, last = alignment.overlaps(a, b)
        spans = lambda ends: list(zip([0, *ends[:-1]], ends))
        for (s, e), x, y in zip(spans(a), first, last):
            assert [k for k, (p, q) in enumerate(spans(b)) if p < e and q > s] == list(range(x, y + 1))
        assert b[alignment.group_ends(first, last, len(b))].tolist() == sorted(set(a) & set(b))


def test_links_of_a_hot_pair_are_counted_once_per_task(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "'the end of the end' AS text").repartition(4)
    aligned = alignment.align(docs, BYTE, PIECE)
    counts = {r.pair: r.n for r in alignment.link_counts(aligned, len(alignment._tokenizers(BYTE, PIECE).pairs)).collect()}
    assert sorted(counts.values()) == [2000, 4000, 4000]
