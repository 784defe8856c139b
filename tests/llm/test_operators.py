"""Each operator against brute force, on a table with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lonja.llm import components as cc
from lonja.llm import exact_dedup, lattice_lm, minhash, mixing, packing, pii, sharding, suffix_dedup, topk, toxicity
from lonja.llm.queries import byte_bpe, tokenizer

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, run int, size string, node string, keep_id long"


def make_rows():
    rng = random.Random(3)
    words = ["alpha", "beta", "Gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "Ñandú", "naïve"]
    text = lambda n: " ".join(rng.choice(words) + (str(rng.randrange(30)) if rng.random() < 0.5 else "") for _ in range(n))
    base, passage = text(120), text(14)
    rows = [(1, base), (2, base), (3, base + "\n"), (4, base.replace(" ", "\t")), (5, None), (6, ""), (7, " \n "), (8, "one"), (9, "one"), (10, "ONE two"), (11, text(9000)), (12, "a" * 70000)]
    for i in range(13, 40):
        t = base.split()
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = "changed"
        rows.append((i, " ".join(t)))
    rows += [(i, text(30) + " " + passage + " " + text(rng.randrange(1, 60))) for i in range(40, 70)]
    rows += [(3, base + "\n"), (None, base), (None, None), (70, base), (70, text(40)), (100, "x"), (150, "y  z"), (71, "é" * 49), (72, "é" * 49)]
    sources = ["a", "b", None, "c", "B"]
    return [(d, t, "en", sources[(i * 7) % 5] if i % 3 else "a", len(t or ""), 0, 1, "clash", "n", 5) for i, (d, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(rows):
    return sorted(rows, key=repr)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_top_k(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(-100, 400)]
    rows += [(1000 + i, [0.5] * 6) for i in range(60)]  # ties
    rows += [(500, None), (550, [1.0, None]), (600, [float("nan")] * 6), (650, [float("inf")] * 6), (None, [1.0] * 6), (700, []), (750, [2.0]), (1000, [0.5] * 6), (50, [9.0] * 6), (50, [-9.0] * 6), (1001, [90.0] * 6), (2, [1000.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).repartition(5)
    sound = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = []
    for n, (q, v) in enumerate(sound):
        if q % 50 == 0:
            best = sorted((-dot(v, w), i) for m, (i, w) in enumerate(sound) if m != n)[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    for shard_rows in (100000, 40):
        assert key(map(tuple, topk.top_k(df, shard_rows=shard_rows, group_rows=7).collect())) == key(want)
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_large_values():
    q, c = np.array([[2.0**40, -(2.0**45)]]), np.array([[2.0**30, 1.0], [2.0**31, 5.0], [1.0, 1.0]])
    a, b, s = topk.best_of(q, np.array([7]), c, np.array([1, 2, 9]), np.array([5, 6, 7]), 5)
    assert list(zip(a, b, s)) == [(0, 1, (1 << 63) - 1), (0, 0, (1 << 63) - 1)]


def test_toxicity(spark, docs, rows):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = toxicity.score(real, toxicity.learn(real, labels)).join(labels, "doc_id").filter("held_out").toPandas()
    hit = (got["predicted"] == 1) & (got["toxic"] == 1)
    assert hit.sum() / (got["toxic"] == 1).sum() > 0.6 and hit.sum() / max(1, got["predicted"].sum()) > 0.7
    assert got["held_out"].equals(got["doc_id"].map(lambda d: zlib.crc32(str(d).encode()) % 4 == 2))
    some = spark.createDataFrame([(1, 1), (13, 0), (13, 1), (14, 0), (15, 0), (None, 1), (16, None)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.learn(docs, some)).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    assert toxicity.learn(docs, some.limit(0)) is None and toxicity.score(docs, None).count() == len(rows)
    assert toxicity.score(empty(spark), None).count() == 0


def brute_components(data, width, percent):
    sets = []
    for _, t in data:
        w = (t or "").encode().lower().split()
        k = min(width, len(w)) or 1
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    up = list(range(len(data)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), c := least.get(find(i)), d == c) for i, (d, _) in enumerate(data)]


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, docs, rows, real, width, percent):
    for df in (docs, real):
        assert key(map(tuple, minhash.near_duplicates(df, width, percent).collect())) == key(brute_components(pairs(df), width, percent))
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_components(spark, monkeypatch):
    """Chains, stars, rings and loose pairs over many partitions, contracted a few edges at a time."""
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(1001, 1100)] + [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)] + [(rng.randrange(3000, 3200), rng.randrange(3000, 3200)) for _ in range(120)] + [(7, 7), (5, 4), (5, 4)]
    rng.shuffle(edges)
    up = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(400):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    monkeypatch.setattr(cc, "_EDGES", 1)
    got = cc.components(spark.createDataFrame(edges, "a long, b long").repartition(12)).collect()
    assert sorted(map(tuple, got)) == sorted(up.items())
    assert cc.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_duplicate_chain(spark):
    """Copies that drift apart: no star covers them, so mixed buckets have to be gone through."""
    rng, rows = random.Random(9), []
    for g in range(6):
        w = [f"w{g}x{i}" for i in range(150)]
        for i in range(120):
            w = list(w)
            w[rng.randrange(len(w))] = f"n{g}x{i}"
            rows.append((g * 1000 + i, " ".join(w if rng.random() < 0.9 else rng.sample(w, len(w)))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert key(map(tuple, minhash.near_duplicates(df).collect())) == key(brute_components(rows, 3, 85))


def test_signature_is_a_fair_estimate():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    b = np.append(a[:240], rng.integers(0, 1 << 63, 60).astype(np.uint64))
    same = np.mean(minhash.signature(np.unique(a), 1024) == minhash.signature(np.unique(b), 1024))
    assert abs(same - 240 / 360) < 0.06


def test_sainte_lague():
    def slow(w, seats, cap):
        got = [0] * len(w)
        for _ in range(min(seats, sum(c for c, x in zip(cap, w) if x > 0))):
            i = max((i for i in range(len(w)) if got[i] < cap[i] and w[i] > 0), key=lambda i: (w[i] / (2 * got[i] + 1), -i))
            got[i] += 1
        return got

    rng = random.Random(2)
    for _ in range(200):
        w = [rng.choice([0, rng.random() * 10, rng.randrange(1, 9)]) for _ in range(rng.randrange(1, 7))]
        cap = [rng.randrange(0, 30) for _ in w]
        seats = rng.randrange(0, 60)
        got = mixing.sainte_lague(w, seats, cap)
        assert got.sum() == sum(slow(w, seats, cap)) and (got <= cap).all()
        if len(set(w)) == len(w):
            assert list(got) == slow(w, seats, cap)


def test_mixing(spark, docs, rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for df in (docs, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        data = df.select("doc_id", "text", "source").collect()
        out = mixing.mix(df).collect()
        assert key((r["doc_id"], r["size"], r["taken"]) for r in out) == key((r["doc_id"], r["size"], r["taken"]) for r in mixing.mix(df.repartition(2)).collect())
        assert key((r["doc_id"], r["size"]) for r in out) == key((r["doc_id"], size(r["text"])) for r in data)
        total = Counter()
        for r in data:
            total[r["source"]] += size(r["text"])
        order = sorted(total, key=lambda s: (s is None, s or ""))
        aim, open_, left = {}, set(order), sum(total.values())
        w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        while open_:
            each = left / sum(w[s] for s in open_)
            over = {s for s in open_ if w[s] * each > 3 * total[s]}
            for s in over or open_:
                aim[s] = 3 * total[s] if over else w[s] * each
            left -= sum(aim[s] for s in over)
            open_ = open_ - over if over else set()
        taken = Counter()
        for r in out:
            assert r["source_size"] == total[r["source"]] and abs(r["target"] - aim[r["source"]]) < 1e-6 * max(1, aim[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
            taken[r["source"]] += r["taken"]
        assert all(abs(taken[s] - aim[s]) <= max(30, 0.02 * aim[s]) for s in total), (taken, aim)
        mixed, plan = defaultdict(int), defaultdict(int)
        for r in mixing.mixed(df).collect():
            mixed[r["doc_id"]] += size(r["text"])
        for r in out:
            plan[r["doc_id"]] += r["taken"]
        assert {k: v for k, v in plan.items() if v} == dict(mixed)
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0
    assert {r["taken"] for r in mixing.mix(docs.withColumn("text", F.lit(None).cast("string"))).collect()} == {0}


def test_exact_dedup(spark, docs, rows, real):
    for df in (docs, real):
        data = pairs(df)
        groups = defaultdict(list)
        for d, t in data:
            groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d))
        want = []
        for d, t in data:
            n = re.sub(r"[\x20\x09-\x0D]", "", t or "")
            less, _, keep = min(groups[n], key=lambda x: (x[0], x[1], x[2] or 0))
            want.append((d, keep, len(groups[n]), d == keep and len(t or "") == -less, hashlib.sha256(n.encode()).hexdigest()))
        assert key(map(tuple, exact_dedup.exact_dedup(df).collect())) == key(want)
        left = exact_dedup.drop_duplicates(df)
        assert left.columns == df.columns and key(r["doc_id"] for r in left.collect()) == key(min(g, key=lambda x: (x[0], x[1], x[2] or 0))[2] for g in groups.values())
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_pii(t):
    t, spans = t or "", []
    for k, p in enumerate([r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]):
        for m in re.finditer(p, t):
            d = [int(c) for c in m[0] if c.isdigit()]
            luhn = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 12 <= len(d) <= 19 and luhn or k == 3 and 9 <= len(d) <= 15:
                spans.append((m.start(), k, m.end()))
    return [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)]


def test_pii_spans_against_plain_patterns():
    rng = random.Random(4)
    bits = ["a", "b@", "@", ".", "c.d", "1", "23", "256", ".0.0.1", "4111 1111-1111 1111", "+1 (555) 010-9999", "-", " ", "+", "é", "x@y.z", "x@y..z", "(", ")", "0", "4539578763621486", "  ", "\n", "٣"]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 25)))
        assert [f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in pii.base_spans(t)] == brute_pii(t), t


def test_pii_proposals_against_all_pairs():
    rng = random.Random(5)
    bits = ["555-123-4567", "(555) 123 4567", "0049 30 123 456", "4111 1111 1111 1112", "4111111111111111", "+49 30 1234567", "a [at] b [dot] com", "a@b.de", "1.2.3.4", " ", "-", "x", "00"]
    for _ in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))
        base, out = pii.base_spans(text), []
        for kind, pattern in pii._WIDER:
            for m in pattern.finditer(text):
                if all(m.end() <= a or m.start() >= b for a, b, _ in [*base, *out]):
                    out.append((m.start(), m.end(), pii.KINDS.index(kind)))
        assert pii.candidates(text, base) == sorted(out), text
    many = "555-123-4567 a@b.de " * 40_000
    began = time.process_time()
    assert len(pii.candidates(many, pii.base_spans(many))) == 40_000 and time.process_time() - began < 20


def test_pii_estimates_against_plain_ones():
    """Expectation-maximisation candidate by candidate, without counts of patterns; the classifier's loss is flat at its weights."""
    rng = random.Random(9)
    pattern = lambda good: "".join(rng.choices("+0-", (6, 3, 1) if good else (1, 3, 6))[0] for _ in pii.LABELERS)
    rows = [rng.choice(["email", "phone"]) + pattern(rng.random() < 0.6) for _ in range(120)]
    counted = sorted((p, rows.count(p)) for p in set(rows))
    got = pii.aggregate(counted, rounds=15)
    for kind in ("email", "phone"):
        own = [r[len(kind) :] for r in rows if r.startswith(kind)]
        chance = [min(0.95, max(0.05, 0.5 + 0.15 * (v.count("+") - v.count("-")))) for v in own]
        for _ in range(15):
            prior, score = (sum(chance) + 1) / (len(own) + 2), {}
            for good in (False, True):
                weight = [c if good else 1 - c for c in chance]
                told = []
                for i in range(len(pii.LABELERS)):
                    sums = {"-": 0.3 + 2.0 * (not good), "0": 0.5, "+": 0.3 + 2.0 * good}
                    for v, w in zip(own, weight):
                        sums[v[i]] += w
                    told.append({c: x / sum(sums.values()) for c, x in sums.items()})
                score[good] = [(prior if good else 1 - prior) * math.prod(t[c] for t, c in zip(told, v)) for v in own]
            chance = [y / (y + n) for y, n in zip(score[True], score[False])]
        assert all(abs(got[kind + v] - c) < 1e-9 for v, c in zip(own, chance))
    w = pii.train(counted, got)
    slope = [1e-3 * k for k in w]
    total = sum(math.log1p(n) for _, n in counted)
    for p, n in counted:
        x = pii.span_features(p)
        miss = 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, w)))) - got[p]
        slope = [g + math.log1p(n) * miss * a / total for g, a in zip(slope, x)]
    assert max(map(abs, slope)) < 1e-7


def test_pii(spark, docs, rows, real):
    more = [(200, "call +1 (555) 010-9999 or write to a.b@c.example.com"), (201, "phone: 555-010-1234, tel (555) 010-4321"), (202, "mail me: joe (at) site (dot) org"), (203, "card 4111 1111 1111 1111 and 1.2.3.4"), (204, "7" * 50000), (205, "a" * 50000 + "@")]
    df = docs.select("doc_id", "text").unionAll(spark.createDataFrame(more, "doc_id long, text string")).withColumn("base", F.lit("clash"))
    for d in (df, real):
        by = defaultdict(list)
        for i, t in pairs(d):
            by[i].append(brute_pii(t))
        out = pii.personal_data(d).collect()
        assert len(out) == sum(map(len, by.values()))
        for r in out:
            b = next(b for b in by[r["doc_id"]] if hashlib.sha256(",".join(b).encode()).hexdigest() == r["base_sha256"])
            assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s.startswith(k) for s in b) for k in pii.KINDS]
            assert set(b) <= set(r["spans"].split(",")) if b else True
    got = {r["doc_id"]: r for r in pii.personal_data(df).filter("doc_id >= 200").collect()}
    assert got[201]["n_added"] == 2 and got[202]["n_added"] == 1
    assert pii.personal_data(empty(spark)).count() == 0


def test_lattice(spark, docs, rows, real):
    model = tokenizer("piece_bpe_32k.model")
    for df in (docs, real):
        data, count = pairs(df), Counter()
        held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
        tokens = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None]
        for d, t in data:
            if not held(d):
                count.update(tokens(t))
        n, v = sum(count.values()), len(count)
        want = defaultdict(list)
        for d, t in data:
            x = tokens(t)
            want[d].append((held(d), len(x), sum(w in count for w in x), n, sum(np.log10((count[w] + 1) / (n + v + 1)) for w in x)))
        out = lattice_lm.score(df, model, hot=50).collect()
        assert len(out) == len(data)
        for r in out:
            assert any((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4] and abs(r["base_score"] - w[4]) < 1e-6 * max(1, abs(w[4])) for w in want[r["doc_id"]]), r
            assert r["score"] < 0
    assert lattice_lm.score(empty(spark), model).count() == 0


def test_lattice_sums_all_segmentations():
    logp = {f"<0x{b:02X}>": -9.0 for b in range(256)} | {"▁": -1.0, "▁a": -2.0, "a": -1.5, "b": -1.7, "ab": -0.9, "": -3.0}
    lattice = lattice_lm.Lattice(logp)

    def total(s):
        if not s:
            return 1.0
        out = np.exp(-9.0 * len(s[0].encode())) * total(s[1:])
        return out + sum(np.exp(p) * total(s[len(x) :]) for x, p in logp.items() if x and s.startswith(x))

    for w in ("a", "ab", "abab", "bé", "xaab"):
        assert abs(np.exp(lattice.word(w.encode())) - total("▁" + w)) < 1e-12


def test_packing(spark, docs, rows, real):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    for df in (docs, real):
        want, total = Counter(), 0
        for d, x in pairs(df):
            ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
            total += len(ids)
            want[d, zlib.crc32(np.asarray(ids, "<u4").tobytes())] += 1
        out = packing.pack(packing.encoded(df, byte_bpe(), with_ids=True)).toPandas()
        assert out["length"].sum() == total and out["length"].max() <= 2048
        for _, g in out.sort_values("offset").groupby("sequence_id"):
            assert (g["offset"] == g["length"].cumsum() - g["length"]).all() and g["length"].sum() <= 2048
        assert all(zlib.crc32(np.asarray(i, "<u4").tobytes()) == c for i, c in zip(out["ids"], out["ids_crc32"]))
        assert out["sequence_id"].nunique() <= -(-total // 2048) + 1 + sum(out["length"] > 1024) * 0.05
        once = out[~out["doc_id"].isin([3, 70]) & out["doc_id"].notna()]
        for d, g in once.sort_values("piece").groupby("doc_id"):
            assert (d, zlib.crc32(np.asarray(sum(map(list, g["ids"]), []), "<u4").tobytes())) in want and (g["start"] == g["length"].cumsum() - g["length"]).all()
    assert packing.pack(packing.encoded(empty(spark), byte_bpe())).count() == 0


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    t, e, rng = Tokenizer.from_file(path), packing.Encoder(*byte_bpe()), random.Random(8)
    bits = [" ", "  ", "\n", "\t", "a", "don't", "'s", "Ñ", "12", "!?", " ", " ", "　", "\x1c", "\x85", "<|endoftext|>", "x y", "\r\n", "日本", "🙂", "​", "\x00"]
    long = ["^" * 3000, " " * 100000, "a" * 3000, "ab " * 5000, "x" + "\n" * 5000 + "y", "1" * 1999]
    for s in [*long, *("".join(rng.choice(bits) for _ in range(rng.randrange(0, 14))) for _ in range(3000))]:
        assert np.frombuffer(e(s), "<u4").tolist() == t.encode(s, add_special_tokens=False).ids, repr(s)


def test_best_fit_takes_the_tightest_bin():
    rng = random.Random(6)
    for _ in range(50):
        sizes = [rng.randrange(1, 33) for _ in range(rng.randrange(1, 60))]
        room, want = [], []
        for n in sorted(sizes, reverse=True):
            fits = [r for r in room if r >= n]
            want.append(min(fits, default=32) - n)
            if fits:
                room.remove(min(fits))
            room.append(want[-1])
        b, o = packing.best_fit_decreasing(sizes, 32)
        used = Counter()
        for x, n in zip(b.tolist(), sizes):
            used[x] += n
        assert sorted(32 - u for u in used.values()) == sorted(room)


def test_sharding(spark, docs, rows, real):
    for df in (docs, real):
        out, table = sharding.shard(df)
        got = out.toPandas()
        data = pairs(df)
        assert key(zip(got["doc_id"].astype(object).where(got["doc_id"].notna(), None), got["size"], got["text_crc32"])) == key((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in data)
        for _, g in got.groupby("shard"):
            assert sorted(g["slot"]) == list(range(len(g)))
        assert got["shard"].between(0, 39).all() and set(got["law"]) == {"bytes"}
        versions = Counter(r["version"] for r in table.collect())
        assert versions[0] == sharding.SLOTS and set(versions) <= {0, 1} and versions[1] < sharding.SLOTS
    big = spark.range(30000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab"), (F.col("id") % 97).cast("int")).alias("text"))
    b = [r["b"] for r in sharding.shard(big)[0].groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(b) == 40 and max(b) - min(b) < 0.01 * max(b)
    assert sharding.shard(empty(spark))[0].count() == 0
    assert not re.search("Python|Pandas|Arrow", sharding.shard(docs)[0]._jdf.queryExecution().toString())


def brute_passages(data, depth=50):
    first = {}
    for d, t in data:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - depth + 1):
                w = b[i : i + depth]
                first[w] = min(d, first.get(w, d))
    out = []
    for d, t in data:
        b = (t or "").encode()
        mask = np.zeros(len(b), bool)
        if d is not None:
            for i in range(len(b) - depth + 1):
                if first[b[i : i + depth]] < d:
                    mask[i : i + depth] = True
        starts = int((np.diff(np.append(0, mask.astype(int))) == 1).sum())
        out.append((d, len(b), int(mask.sum()), starts, hashlib.sha256(np.frombuffer(b, np.uint8)[~mask].tobytes()).hexdigest()))
    return out


def test_repeated_passages(spark, docs, rows, real):
    more = [(300, "z" * 49), (301, "z" * 50), (302, "z" * 51), (299, "z" * 120), (303, "ab" * 200), (304, "ab" * 26), (305, "q" + "ab" * 300 + "abc" * 40), (306, "abc" * 17)]
    df = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    for d in (df, real):
        assert key(map(tuple, suffix_dedup.repeated_passages(d).collect())) == key(brute_passages(pairs(d)))
    assert suffix_dedup.repeated_passages(empty(spark)).count() == 0
