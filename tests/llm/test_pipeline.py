"""Each stage of the pipeline against a plain version of it, on what the stage before it kept."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lonja.llm.common import documents, written
from lonja.llm.mixing import WEIGHTS, targets
from lonja.llm.queries import tokenizer

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[\x20\x09-\x0D]")


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage got and returned, by the stage's name."""
    docs, out = documents(spark, SF), {}
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, SF), name)
        out[name] = (docs.collect(), after.collect(), docs.columns, after.columns)
        docs = after
    return out


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def test_columns_stay(kept):
    for name in ("toxicity", "exact_dedup", "near_dedup", "mixing"):
        assert kept[name][2] == kept[name][3]


def test_toxic_documents_go(spark, kept):
    before, after, *_ = kept["toxicity"]
    left = {r.doc_id for r in after}
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [r.doc_id for r in before if toxic.get(r.doc_id) == 0]
    assert set(after) <= set(before) and len(after) == len(left)
    assert sum(d in left for d in clean) >= 0.98 * len(clean)


def test_one_of_equal_texts_stays(kept):
    before, after, *_ = kept["exact_dedup"]
    best = {}
    for r in before:
        k = SPACE.sub("", r.text or "")
        best[k] = min(best.get(k, r), r, key=lambda r: (-len(r.text or ""), r.doc_id))
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in best.values()) and set(after) <= set(before)


def test_one_of_each_near_group_stays(kept):
    before, after, *_ = kept["near_dedup"]
    shingles = {}
    for r in before:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or ""))
        shingles[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    label = {d: d for d in shingles}

    def top(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(shingles)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(shingles[a] & shingles[b])
            if both and 100 * both >= 80 * (len(shingles[a]) + len(shingles[b]) - both):
                a_, b_ = sorted((top(a), top(b)))
                label[b_] = a_
    assert sorted(r.doc_id for r in after) == [d for d in ids if top(d) == d] and set(after) <= set(before)


def test_mix_comes_near_its_targets(kept):
    before, after, *_ = kept["mixing"]
    size, got, texts, most = defaultdict(int), defaultdict(int), {r.doc_id: r for r in before}, defaultdict(int)
    for r in before:
        size[r.source] += len(words(r.text))
    for r in after:
        got[r.source] += len(words(r.text))
        most[r.doc_id] += len(words(r.text))
        assert set(words(r.text)) <= set(words(texts[r.doc_id].text)) and r.source == texts[r.doc_id].source
    names = sorted(size, key=lambda s: (s is None, s or ""))
    for s, aim in zip(names, targets([size[s] for s in names], [WEIGHTS[i % 3] for i in range(len(names))])):
        assert got[s] == pytest.approx(aim, rel=0.05, abs=64)
    assert all(n <= 3 * len(words(texts[d].text)) for d, n in most.items())


def test_packed_pieces_are_the_documents(kept):
    before, after, *_ = kept["packing"]
    coder, want, bins = Tokenizer.from_file(tokenizer("byte_bpe_50k.json")), defaultdict(int), defaultdict(list)
    for r in before:
        want[r.doc_id] += len(coder.encode(r.text or "", add_special_tokens=False).ids) + 1
    got = defaultdict(int)
    for r in after:
        got[r.doc_id] += r.length
        bins[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    whole = {r.doc_id: r for r in after if r.start == 0 and r.length == want[r.doc_id]}
    once = [r for r in before if r.doc_id in whole and sum(x.doc_id == r.doc_id for x in before) == 1]
    for r in once[:40]:
        ids = np.array([*coder.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert whole[r.doc_id].ids_crc32 == zlib.crc32(ids.tobytes())


def test_stages_take_any_rows(spark):
    """Nulls, empty and very long texts, repeats, clashing columns and no rows at all: no stage fails, and those before the last keep the columns."""
    from tests.llm.test_operators import SCHEMA, make_rows

    for rows in (make_rows(), []):
        docs = spark.createDataFrame(rows, SCHEMA)
        for name, stage in corpus_pipeline.STAGES:
            after = written(stage(spark, docs, SF), name)
            assert name == "packing" or after.columns == docs.columns
            if name in ("exact_dedup", "near_dedup"):
                assert set(map(tuple, after.collect())) <= set(map(tuple, docs.collect()))
            if name == "exact_dedup" and rows:
                texts = [SPACE.sub("", r.text or "") for r in after.collect()]
                assert len(texts) == len(set(texts))
            docs = after
        assert (docs.count() > 0) == bool(rows)
