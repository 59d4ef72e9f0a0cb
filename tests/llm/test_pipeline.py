"""Stages of the pipeline against brute force."""

import numpy as np

import corpus_pipeline
from evidentia.llm import neardup


def _kept(rows, least=0.8):
    """Ids that stay: the smallest of each component of texts with a Jaccard of five-word shingles of ``least`` or more."""
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i, _ in rows}
    for _ in range(len(rows)):
        before = dict(root)
        for a in root:
            for b in root:
                if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-12:
                    root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    return set(root.values())


def test_near_dedup_verifies_resemblance(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(25):
        words = [f"w{x}" for x in rng.integers(0, 4000, int(rng.integers(8, 160)))]
        rows.append((len(rows), " ".join(words)))
        for edits in (1, 1, 2, 3, 5):
            copy = list(words)
            for at in rng.integers(0, len(copy), edits):
                copy[at] = f"v{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(copy)))
        # A common run, half of the text: no near copy.
        rows.append((len(rows), "one two three four five six seven eight nine ten " + " ".join(f"u{x}" for x in rng.integers(0, 10**6, 12))))
    rows += [(len(rows), rows[0][1])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = _kept(rows)
    got = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # Clusters cut into many cells, and no common shingle put last, find the same.
    cells = [r.doc_id for r in neardup.one_of_each(docs, sample=1, most_often=1, cell=200, step=2, broadcast_rows=1).collect()]
    assert sorted(cells) == sorted(got)
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_near_dedup_with_runs_that_repeat_within_a_text(spark):
    """Boilerplate a thousand times over is one shingle of the set, and moves neither resemblance nor fingerprint."""
    rng = np.random.default_rng(11)
    common = " ".join(f"w{x}" for x in rng.integers(0, 10**6, 200))
    rows = [(k, common + " " + " ".join([f"a{k} b{k} c{k} d{k}" + (" e" if k % 2 else "")] * 1000)) for k in range(6)]
    rows += [(10 + k, " ".join([f"x{k} y{k} z{k}"] * 500) + " " + " ".join(f"v{x}" for x in rng.integers(0, 10**6, 150))) for k in range(3)]
    # Sets of five shingles of which four are shared, and of up to 70.
    for g, size in enumerate((5, 6, 9, 20, 40, 64, 70)):
        words = [f"s{g}x{x}" for x in range(size + 4)]
        rows += [(100 * (g + 1), " ".join(words)), (100 * (g + 1) + 1, " ".join([*words[:-1], "other"])), (100 * (g + 1) + 2, " ".join([*words, "more"]))]
    want = _kept(rows)
    assert {0, 10, 11, 12} <= want and not {1, 2, 3, 4, 5} & want
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == want


def test_sequences_follow_the_mix(spark, tmp_path):
    counts, weights = {"src0": 256, "src1": 128}, {"src0": 4, "src1": 2}
    rows = [(f"{s}", " ".join(["word"] * (40 + 200 * (k % 7)))) for s, n in counts.items() for k in range(n)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, (s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    # Earliest deadline first, a block of 32 documents a slot.
    total, served, want = 6, dict.fromkeys(counts, 0), []
    for slot in range(sum(counts.values()) // 32):
        free = [(-(-(served[s] + 1) * total // w), s) for s, w in weights.items() if served[s] * total // w <= slot and 32 * served[s] < counts[s]]
        source = min(free)[1]
        served[source] += 1
        want += [source] * 32
    # Files that a reader packs by size: the last ranges are the largest.
    mixed = corpus_pipeline.source_mix(spark, docs, "").repartition(7, "doc_id")
    mixed.write.parquet(f"{tmp_path}/mix")
    pieces = corpus_pipeline.pack(spark, spark.read.parquet(f"{tmp_path}/mix"), "").collect()
    assert len({p.doc_id for p in pieces}) == len(rows)
    parts = {}
    for p in pieces:
        parts.setdefault(p.sequence_id >> 32, set()).add(p.doc_id)
    at = 0
    for k in sorted(parts):
        got = sorted(rows[i][0] for i in parts[k])
        assert got == sorted(want[at : at + len(got)])
        at += len(got)
    position = {r.doc_id: r.position for r in mixed.collect()}
    for k in parts:
        mean = {}
        for p in pieces:
            if p.sequence_id >> 32 == k:
                held = mean.setdefault(p.sequence_id, [0, 0])
                held[0] += sorted(position[i] for i in parts[k]).index(position[p.doc_id]) * p.length
                held[1] += p.length
        order = [mean[s][0] / mean[s][1] for s in sorted(mean)]
        assert order == sorted(order)
