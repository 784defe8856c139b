"""Cases that once went wrong: crowds of close but unlinked texts, null and repeated ids, clashing names, tiny sources, stored maps."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lonja.llm import exact_dedup, lattice_lm, minhash, mixing, packing, sharding, toxicity
from lonja.llm.queries import byte_bpe
from tests.llm.test_operators import brute_components, key, pairs


def crowd(n, words=90, most=12, seed=5):
    """Copies of one text with some words changed: near to each other, many of them linked with none."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randrange(most)):
            t[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_crowd_of_close_texts(spark, monkeypatch, width, percent):
    monkeypatch.setattr(minhash, "CELL", 16)
    monkeypatch.setattr(minhash, "SPOKES", 20)
    docs = spark.createDataFrame(list(enumerate(crowd(260))), "doc_id long, text string").repartition(4)
    got = minhash.near_duplicates(docs, width, percent).collect()
    want = brute_components(pairs(docs), width, percent)
    assert key(map(tuple, got)) == key(want)
    sizes = Counter(r.component_id for r in got)
    assert max(sizes.values()) > 20 and sum(n == 1 for n in sizes.values()) > 20


def test_rows_without_partner_leave_before_the_comparison(spark):
    """No row of a mixed bucket that is linked leaves; most that are not do."""
    docs = spark.createDataFrame(list(enumerate(crowd(200))), "doc_id long, text string")
    seen, inner = [], minhash._linkable

    def noted(rest, sets, percent):
        out = inner(rest, sets, percent)
        seen.append((rest.select("node").distinct().count(), out.count()))
        return out

    minhash._linkable = noted
    try:
        minhash.near_duplicates(docs, 5, 80).collect()
    finally:
        minhash._linkable = inner
    assert seen[0][1] < 0.8 * seen[0][0]


def test_near_duplicates_with_null_and_repeated_ids(spark):
    texts = crowd(12, most=2) + crowd(6, seed=8, most=1) + ["", " ", None]
    rows = [(None, t) for t in texts] + [(5, texts[0]), (5, texts[0]), (5, texts[14]), (4, texts[14]), (None, texts[0])]
    docs = spark.createDataFrame([(d, t, "a", i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, mark string, row int")
    marked = minhash.near_duplicates(docs, 5, 80).collect()
    assert len(marked) == len(rows)
    kept = minhash.drop_near_duplicates(docs).collect()
    assert kept[0].__fields__ == docs.columns and set(map(tuple, kept)) <= set(map(tuple, docs.collect()))
    worded = [r for r in kept if r.text and r.text.strip()]
    assert len(worded) == 2 and sorted(r.doc_id for r in worded) == [4, 5] and len(kept) - len(worded) == 3
    assert minhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_longest_of_equal_texts_stays_once(spark):
    """Rows that repeat a doc_id and differ in white space only: the longest stays, once, in any order and partitioning."""
    rows = [(7, "a b", 1), (7, "a   b     ", 2), (7, "a   b     ", 3), (7, "a\t\t\tb     ", 4), (8, "a b", 5), (None, "c", 6), (None, "c", 7), (9, None, 8), (9, "", 9)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, _n long").repartition(3)
        kept = exact_dedup.drop_duplicates(docs).collect()
        assert sorted((str(r.doc_id), len(r.text or "")) for r in kept) == [("7", 10), ("9", 0), ("None", 1)]
        assert kept[0].__fields__ == ["doc_id", "text", "_n"] and set(map(tuple, kept)) <= set(rows)


@pytest.mark.parametrize("fan_in", [2, 3, 8])
def test_runs_merge_in_rounds(spark, fan_in):
    """A third of the rows is one text; every round leaves at most fan_in rows a digest and run, and the last one row."""
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 50}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs, fan_in).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    assert got == {i: (min(groups[t]), len(groups[t]), i == min(groups[t])) for i, t in rows}
    first = exact_dedup.digests(docs).withColumn("run", F.pmod(F.spark_partition_id(), F.lit(fan_in**2)).cast("int"))
    first = first.groupBy("run", *exact_dedup.KEY).agg(F.min(F.struct("n_chars", "doc_id")).alias("best"), F.count("*").alias("n"))
    left = exact_dedup.merged_runs(first, fan_in, 2)
    assert left.count() == len(groups)
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortAggregate") >= 2 and "Sort [run" in plan


def test_one_tiny_source_leaves_the_blocks_of_others_whole(spark):
    """Sources are cut into long stretches, not into single words, whatever the size of the smallest one; names may clash."""
    text = lambda i, n: " ".join(f"w{i}_{j}" for j in range(n))
    rows = [(i, text(i, 400), "big", str(i), -i, 0) for i in range(900)] + [(1000 + i, text(i, 5), "tiny", "s", 1, 0) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string, _n long, label int")
    out = mixing.mixed(docs, weights=(1, 1), rows_per_shard=64).collect()
    assert {r.size for r in out} <= {r[3] for r in rows} and out[0].__fields__ == docs.columns
    big = [r for r in out if r.source == "big"]
    stretches = [s.split() for r in big for s in r.text.split("\n")]
    assert sum(len(s) >= 16 for s in stretches) > 0.9 * len(stretches)
    taken = Counter()
    for r in out:
        taken[r.source] += len(r.text.split())
    plan = {r.source: r.target for r in mixing.mix(docs, weights=(1, 1), rows_per_shard=64).collect()}
    assert all(abs(taken[s] - t) <= max(64, 0.02 * t) for s, t in plan.items())


def test_special_tokens_have_the_ids_of_the_tokenizer(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(byte_bpe()[0])
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext", "plain"]
    out = packing.pack(packing.encoded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), byte_bpe())).collect()
    for r in out:
        ids = [*t.encode(texts[r.doc_id], add_special_tokens=False).ids, 0]
        assert r.length == len(ids) and r.ids_crc32 == zlib.crc32(np.asarray(ids, "<u4").tobytes())
    assert 50256 in t.encode(texts[0], add_special_tokens=False).ids


def test_stored_map_is_edited(spark, tmp_path):
    """Two rebalancings from storage: each starts from the latest version, appends moved slots only, and keeps all other records in place."""
    path = str(tmp_path / "map")
    docs = lambda n, k: spark.range(n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab"), (F.col("id") % k).cast("int")).alias("text"))
    where, versions = {}, []
    for n, k, shards in ((3000, 40, 8), (4000, 90, 8), (4000, 90, 10)):
        out, table = sharding.shard(docs(n, k), shards=shards, slots=512, path=path)
        now = {r.virtual_slot: r.shard for r in out.select("virtual_slot", "shard").distinct().collect()}
        latest = table.agg(F.max("version")).first()[0]
        moved = {r.virtual_slot: r.shard for r in table.filter(F.col("version") == latest).collect()} if versions and latest > versions[-1] else {}
        if where:
            assert moved and len(moved) < 512 and all(now[s] == moved.get(s, where.get(s, now[s])) for s in now)
        held = {}
        for r in sorted(table.collect(), key=lambda r: r.version):
            held[r.virtual_slot] = r.shard
        assert all(held[s] == x for s, x in now.items())
        sizes, slots = [0] * 512, [0] * 512
        for r in out.groupBy("virtual_slot").agg(F.sum("size").alias("b")).collect():
            sizes[r.virtual_slot] = r.b
        before = [where.get(s, s % shards) for s in range(512)] if where else sharding.first_map(512, shards)
        assert [held[s] for s in range(512)] == plain_rebalance(before, sizes, shards)
        where, versions = held, [*versions, latest]


def plain_rebalance(shard_of, sizes, shards):
    """Step by step: from the fullest to the emptiest, the slot that evens them out best."""
    shard_of = list(shard_of)
    while True:
        total = [0] * shards
        for s, b in enumerate(sizes):
            total[shard_of[s]] += b
        a, b = max(range(shards), key=lambda i: (total[i], -i)), min(range(shards), key=lambda i: (total[i], i))
        gap = total[a] - total[b]
        fits = sorted((sizes[s], s) for s in range(len(sizes)) if shard_of[s] == a and 0 < sizes[s] < gap)
        if not fits:
            return shard_of
        low = [x for x in fits if x <= (gap // 2, len(sizes))][-1:]
        high = [x for x in fits if x > (gap // 2, len(sizes))][:1]
        shard_of[min(low + high, key=lambda x: abs(2 * x[0] - gap))[1]] = b


def test_a_large_group_of_equal_texts_spreads(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    n = [r["count"] for r in sharding.shard(docs)[0].filter("size = 29").groupBy("shard").count().collect()]
    assert len(n) == 40 and max(n) < 2 * sum(n) / 40


def plain_nnpu(bags, p, u, d, prior, steps, rate=0.05, decay=1e-3):
    """The same descent with the risk differentiated numerically, document by document."""
    n_p, n_u = sum(p), sum(u)
    soft = lambda z: np.log1p(np.exp(z))

    def parts(x):
        f = np.array([x[list(b)].sum() + x[-1] for b in bags])
        return (p * soft(-f)).sum() / n_p, (p * soft(f)).sum() / n_p, (u * soft(f)).sum() / n_u

    def slope(g, x):
        h = 1e-5
        return np.array([(g(x + h * e) - g(x - h * e)) / (2 * h) for e in np.eye(d + 1)])

    x = np.append(np.zeros(d), np.log(prior / (1 - prior)))
    m, v, back = np.zeros(d + 1), np.zeros(d + 1), 0
    for t in range(1, steps + 1):
        a, b, c = parts(x)
        if c - prior * b >= 0:
            grad = slope(lambda y: prior * parts(y)[0] + parts(y)[2] - prior * parts(y)[1], x)
            grad[:-1] += decay * x[:-1]
        else:
            grad, back = -slope(lambda y: parts(y)[2] - prior * parts(y)[1], x), back + 1
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        x = x - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x[:-1], x[-1], back


@pytest.mark.parametrize("prior,stepped_back", [(0.2, False), (0.6, True)])
def test_nnpu_fit_against_plain_gradients(prior, stepped_back):
    """In both branches: with a prior far above the share of positives the second part of the risk goes negative."""
    rng = random.Random(4)
    bags = [np.array(sorted({rng.randrange(6) for _ in range(3)} if i % 4 else {0, 1}), dtype=np.int64) for i in range(40)]
    p, u = np.array([float(i % 4 == 0) for i in range(40)]), np.array([float(rng.randrange(1, 4)) for _ in range(40)])
    data = toxicity.block(bags, p, u)
    w, b = toxicity.fit_nnpu(lambda w, b: toxicity.risk_sums(data, w, b), 6, p.sum(), u.sum(), prior, steps=60)
    want_w, want_b, back = plain_nnpu(bags, p, u, 6, prior, 60)
    assert (back > 0) == stepped_back
    np.testing.assert_allclose([*w, b], [*want_w, want_b], atol=2e-3)


def test_lattice_document_is_the_sum_over_all_segmentations(spark, monkeypatch):
    """A document's probability is the product over its words, repeats included, and the end of the sum over every way to cut them."""
    pieces = {"▁": 0.1, "a": 0.2, "b": 0.1, "▁a": 0.15, "ab": 0.2, "▁ab": 0.1, "ba": 0.1, "": 0.05}
    toy = {k: float(np.log(v)) for k, v in pieces.items()} | {f"<0x{b:02X}>": -9.0 for b in range(256)}
    monkeypatch.setattr(lattice_lm, "piece_scores", lambda counts, model, ends: toy)

    def total(s):
        one = np.exp(-9.0 * len(s[:1].encode()))
        return 1.0 if not s else one * total(s[1:]) + sum(p * total(s[len(x) :]) for x, p in pieces.items() if x and s.startswith(x))

    rows = [(1, "ab a  AB"), (2, "bab aba ab ab"), (3, None), (4, "cé\tab")]
    out = lattice_lm.score(spark.createDataFrame(rows, "doc_id long, text string"), "unused", hot=2).collect()
    for r in out:
        words = (dict(rows)[r.doc_id] or "").lower().split()
        assert abs(r.score - (sum(np.log10(total("▁" + w)) for w in words) + np.log10(0.05))) < 1e-9


def test_labels_that_no_word_explains_reject_nothing(spark):
    """Every text is the same, some are labelled toxic: there is nothing to learn, and all documents stay."""
    docs = spark.createDataFrame([(i, "the same words") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    assert {r.predicted for r in toxicity.score(docs, model).collect()} == {0} and toxicity.keep_clean(docs, model).count() == 60


def test_a_stored_map_keeps_its_number_of_slots(spark, tmp_path):
    """Runs that ask for more or fewer slots than the stored map has go by the map; a map with a gap is refused."""
    docs = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(300)], "doc_id long, text string")
    path = str(tmp_path / "map")
    first = {r.doc_id: (r.virtual_slot, r.shard) for r in sharding.shard(docs, 4, 64, path)[0].collect()}
    for slots in (128, 16):
        assert {r.doc_id: (r.virtual_slot, r.shard) for r in sharding.shard(docs, 4, slots, path)[0].collect()} == first
    broken = str(tmp_path / "broken")
    spark.createDataFrame([(0, 0, 0), (0, 2, 1)], sharding.MAP).write.parquet(broken)
    with pytest.raises(ValueError):
        sharding.shard(docs, 4, 64, broken)


def test_texts_of_some_ids_are_whole_whatever_the_hashes(spark, monkeypatch):
    """Hashes that collide let texts through to the join, which drops them; none is lost."""
    monkeypatch.setattr(toxicity, "BUCKETS", 3)
    texts = spark.createDataFrame([(i, f"t{i}") for i in range(200)] + [(5, "again"), (None, "nobody")], "doc_id long, text string")
    ids = spark.createDataFrame([(5,), (17,), (999,), (None,)], "doc_id long")
    assert sorted(r.text for r in toxicity.of_ids(texts, ids).collect()) == ["again", "t17", "t5"]
