"""Whole results by plain loops: patterns, fingerprints, trained models as they are applied, removed lines, and the pipeline from end to end."""

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from evidentia.llm import fingerprints, langid, linededup, linear, pii, queries, toxicity


# --- op9: base spans -----------------------------------------------------------------


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def personal(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    return {kind: [(m.start(), m.end()) for m in re.finditer(p, text) if ok(m[0])] for kind, (p, ok) in rules.items()}


def test_personal_data_by_the_rules(spark):
    rng = np.random.default_rng(3)
    parts = ["a.b%c@d-e.f.g", "@", "x@y", "x@y.z", "1.2.3.4", "256.1.1.1", "01.002.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500000000000004", "+49 (30) 555-2485", "+1 2", "+4", "+123456789012345678", "0", "7", ".", "-", " ", "(", "\n", "😀", "é"]
    texts = ["".join(parts[k] for k in rng.integers(0, len(parts), int(rng.integers(1, 14)))) for _ in range(600)] + [None, "", "1" * 3000, "1.2." * 800, "a@b." * 800, "+1 " * 900]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digest(pii.find_personal_data(rows)).collect()}
    assert len(got) == len(texts)
    seen = Counter()
    for i, text in enumerate(texts):
        want = personal(text or "")
        spelled = ",".join(f"{kind}:{a}:{b}" for kind, places in want.items() for a, b in places)
        assert tuple(got[i][f"n_{kind}"] for kind in want) == tuple(map(len, want.values())), text
        assert got[i].base_sha256 == hashlib.sha256(spelled.encode()).hexdigest()
        seen.update({kind: len(places) for kind, places in want.items()})
    assert min(seen.values()) > 20


# --- op3: fingerprints ---------------------------------------------------------------


def chained(*values):
    """XXH64 of each value with the hash before it as its seed, as a signed number."""
    seed = 42
    for value, width in values:
        seed = xxhash.xxh64_intdigest(value if width == 0 else int(value).to_bytes(width, "little", signed=True), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def fingerprint_of(text):
    words = [w.encode() for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    runs = [words[k : k + 5] for k in range(len(words) - 4)] if len(words) >= 5 else []
    hashes = [chained(*((w, 0) for w in run)) for run in runs]
    if not runs and words:  # few words: an array of them is hashed item by item, as the run would be
        hashes = [chained(*((w, 0) for w in words))]
    if not hashes:
        return " " * 128
    bins = [min((h for h in hashes if h >> 57 == b), default=None) for b in range(-64, 64)]
    full = [(h, h >> 57) for h in bins if h is not None]
    out = []
    for i, value in enumerate(bins):
        if value is None:
            near = next((bins[j] for j in fingerprints._probes()[i] if bins[j] is not None), None)
            lent = near if near is not None else min((chained((i, 4), (b, 8)), h) for h, b in full)[1]
            value = chained((lent, 8), (i, 4))
        out.append("%x" % (value & 15))
    return "".join(out)


def test_fingerprints_digit_by_digit(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, int(n))) for n in (1, 4, 5, 6, 9, 30, 200, 2000)] + [None, "", " \n\t ", "é ü x 日本 語 w v", "same " * 500]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(rows).collect()}
    plain = [t or "" for t in texts]
    like = lambda a, b: 1.0 if a == b else max(0.0, (sum(x == y for x, y in zip(a, b)) / 128 - 1 / 16) / (15 / 16))
    for i, text in enumerate(plain):
        after = plain[i - 1]  # ids descend
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        want, want_edited = fingerprint_of(text), fingerprint_of(edited)
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (want, want_edited), i
        assert abs(got[i].near_edited - like(want, want_edited)) < 1e-12 and abs(got[i].near_next - like(want, fingerprint_of(after))) < 1e-12


# --- op6, op7: models as they are applied ---------------------------------------------


def test_languages_by_loops(spark):
    train = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit_languages(train, ~langid.held_out(), sample_rows=240)
    texts = ["The House of THE bear", "Das Haus ist groß", "où est la maison", "el niño está aquí", "x", "12 ß 34", None, "", "123 !", "日本語", "a" * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify_languages(rows, model).collect()}
    for i, text in enumerate(texts):
        if not text or not any(c.isalpha() for c in text):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        data = [b if 97 <= b <= 122 or b >= 128 else 32 for b in f" {text.lower()} ".encode()]
        data = [b for k, b in enumerate(data) if k == 0 or b != 32 or data[k - 1] != 32]
        grams = Counter()
        for k in range(len(data)):
            code = 0
            for n in range(min(3, len(data) - k)):
                code = code * 257 + data[k + n] if n else data[k]
                grams[(code + n) * 2654435761 % 2**32 >> 20] += 1
        total = sum(grams.values())
        x = {g: (c / total) ** 0.5 for g, c in grams.items()}
        score = lambda w: sum(v * float(w[g]) for g, v in x.items()) + float(w[-1])  # noqa: B023, E731
        z = [score(w) for w in model.family]
        best = max(range(len(z)), key=z.__getitem__)
        share = np.exp(4 * z[best]) / np.exp(4 * np.array(z)).sum()
        names, votes = model.languages[best], Counter()
        for (a, b), w in model.duels.items():
            if a in names:
                p = 1 / (1 + np.exp(-4 * score(w)))
                votes.update({a: p, b: 1 - p})
        want = max(names, key=lambda n: votes[n])  # noqa: B023
        assert got[i].lang_pred == want
        assert abs(got[i].score - share * (votes[want] / (len(names) - 1) if len(names) > 1 else 1)) < 1e-3


def test_svm_and_logistic_reach_their_minimum():
    """No small step in any direction makes the loss that is meant smaller."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(80, 5))
    y = (x @ [1, -2, 0, 0.5, 0] + 0.3 + rng.normal(size=80) * 0.7 > 0).astype(int)
    hinge = lambda w: np.mean(np.maximum(0, 1 - (2 * y - 1) * linear.margin(x, w)) ** 2) + 0.005 * (w[:-1] ** 2).sum()
    log = lambda w: np.mean(np.log1p(np.exp(-(2 * y - 1) * linear.margin(x, w)))) + 0.005 * (w[:-1] ** 2).sum()
    for loss, w in ((hinge, linear.squared_hinge_svm(x, 2 * y - 1, 0.01, 3000)), (log, linear.logistic(x, y, 0.01, 3000))):
        steps = [w + 1e-2 * s * d for d in np.eye(6) for s in (1, -1)]
        assert loss(w) < min(map(loss, steps)) + 1e-9


def test_a_chain_learns_from_out_of_fold_guesses_and_is_applied_in_turn(spark):
    rng = np.random.default_rng(7)
    x = (rng.random((120, 6)) < 0.4).astype(np.float32)
    labels = np.stack([x[:, 0] + x[:, 1] > 0.5, x[:, 0] * x[:, 2] > 0.5], 1).astype(int)
    fold = rng.integers(0, 1024, 120)
    weights = toxicity.fit_chain(x, labels, fold)
    guess = np.empty(120, np.float32)
    for k in range(4):
        test = fold % 4 == k
        guess[test] = linear.sigmoid(linear.margin(x[test], linear.logistic(x[~test], labels[~test, 0], 1e-5)))
    assert np.allclose(weights[0], linear.logistic(x, labels[:, 0], 1e-5))
    assert np.allclose(weights[1], linear.logistic(np.hstack([x, guess[:, None]]), labels[:, 1], 1e-5))
    chain = toxicity.Chain(["low", "toxic"], {w: i for i, w in enumerate("ab cd ef gh ij kl".split())}, weights)
    texts = ["AB cd, ef", "kl", "none known", "ab ab_ef", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score_toxicity(rows, chain, ["low", "toxic"]).collect():
        words = set(re.findall(r"[^\W\d_]+", (texts[r.doc_id] or "").lower()))
        given = [float(w in words) for w in chain.vocabulary]
        for p, w in zip((r.p_low, r.p_toxic), weights):
            want = 1 / (1 + np.exp(-(sum(a * float(b) for a, b in zip(given, w)) + float(w[-1]))))
            assert abs(p - want) < 1e-4
            given.append(want)
        assert r.is_toxic == (r.p_toxic > 0.5)


# --- op8 and the pipeline -------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, cb in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (ca != cb))
    return row[-1]


def without_repeats(rows, edits=2, share=0.05, least=16):
    """The texts by id, less each line whose class has an earlier one."""
    lines = [(i, pos, re.sub(r"[^\w]|_", " ", line.lower())) for i, t in sorted(rows) for pos, line in enumerate((t or "").split("\n"))]
    lines = [(i, pos, " ".join(norm.split())) for i, pos, norm in lines]
    norms = sorted({n for _, _, n in lines if len(n) >= least})
    root = {n: n for n in norms}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    letters = {n: Counter(n) for n in norms}
    for k, a in enumerate(norms):
        for b in norms[k + 1 :]:
            apart = (letters[a] - letters[b]).total() + (letters[b] - letters[a]).total()
            if apart <= 2 * edits and abs(len(a) - len(b)) <= edits and distance(a, b) <= min(edits, share * max(len(a), len(b))):
                root[find(a)] = find(b)
    gone, known = set(), set()
    for i, pos, norm in lines:
        if norm in root:
            if find(norm) in known:
                gone.add((i, pos))
            known.add(find(norm))
    return {i: "\n".join(line for pos, line in enumerate((t or "").split("\n")) if (i, pos) not in gone) for i, t in rows}


def corpus(rng, n=60):
    """Texts of a few lines, of which some are lines of others with an edit or two, or copies of whole texts with a word changed."""
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, int(rng.integers(2, 8))))
    pool = [" ".join(word() for _ in range(int(rng.integers(2, 14)))) for _ in range(30)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(int(rng.integers(1, 6))):
            line = list(pool[int(rng.integers(30))] if rng.random() < 0.4 else " ".join(word() for _ in range(9)))
            for _ in range(int(rng.integers(0, 4))):
                at, kind = int(rng.integers(len(line))), int(rng.integers(3))
                line[at : at + (kind != 1)] = [] if kind == 0 else [chr(97 + int(rng.integers(26)))]
            lines.append("".join(line) + (" !" if rng.random() < 0.2 else ""))
        rows.append((i, "\n".join(lines)))
    for i in range(n, n + 12):
        words = " ".join(word() for _ in range(90)).split() if i % 3 == 0 else [*rows[-1][1].split()]
        if i % 3:
            words[5 + i % 7] = word()
        rows.append((i, " ".join(words)))
    return rows


def test_removed_lines_equal_loops_over_pairs(spark):
    rows = [*corpus(np.random.default_rng(8), 80), (100, None), (101, ""), (102, "short line\n\nshort line")]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = without_repeats(rows)
    assert got == want
    assert sum(want[i] != (t or "") for i, t in rows) > 20


def test_pipeline_from_end_to_end(spark, tmp_path):
    """Stage after stage by loops, then every token of what stays, once."""
    from test_pipeline import _kept

    rows = [*corpus(np.random.default_rng(9)), (100, None), (101, "12 34"), (102, "a"), (103, "b b b\n")]
    table = spark.createDataFrame([(i, t, ("en", "de")[i % 2], f"src{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    told = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    less = [(i, t) for i, t in without_repeats(told).items() if re.search(r"[^\W_]", t)]
    kept = _kept(less)
    assert {p.doc_id for p in pieces} == kept and len(told) > len(less) > len(kept) > 30
    tok, texts = Tokenizer.from_file(queries.word_tokenizer()), dict(less)
    for i in kept:
        own = sorted((p.start, p.length) for p in pieces if p.doc_id == i)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
        assert sum(own[-1]) == len(tok.encode(texts[i], add_special_tokens=False).ids) + 1
    for s in {p.sequence_id for p in pieces}:
        at = 0
        for p in sorted((p for p in pieces if p.sequence_id == s), key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
