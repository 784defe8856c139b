"""Personal data by weak supervision.

Four exact patterns give the base spans. Wider patterns propose further candidates of the same kinds, and
labelers vote on every candidate, base spans included: the strict pattern, a checksum, a gazetteer of cue
words close by, the context on both sides, and the layout of the digits. Expectation-maximisation over the
vote patterns estimates, for each kind, how often every labeler is right, and from that the chance that a
candidate is real. A logistic span classifier is trained on these chances; candidates it accepts are added.

Texts are read once; candidates are few. Vote patterns are counted over all documents by Spark, and one
row per distinct pattern (a fixed number at most: kinds x 3 ** labelers) reaches the driver, where the two
models are fitted.

Defined results: null counts as empty; rows that repeat are treated alike. Further columns are ignored. No
rows give no rows. A very long text is scanned whole, in time that grows with its length and its spans, not with
their product. Spans that start at the same place stand in the order of the kinds; of proposals that overlap, the
one of the earlier pattern counts, then the one further left.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.llm.common import written

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("strict", "checksum", "cue", "counter_cue", "context", "layout")
#: Words that speak for or against personal data close by.
CUES = frozenset("email e-mail mail contact write reach phone tel telephone mobile cell call fax whatsapp card visa mastercard amex credit debit account ip host address server correo telefono tarjeta telefon karte courriel carte".split())
COUNTER_CUES = frozenset("version isbn issn doi order invoice sku part serial build release page figure section chapter token key hash commit example price total".split())

_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Proposals beyond the base: spelled-out addresses, national phone layouts, numbers of card length that fail the checksum.
_WIDER = (
    ("email", re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(] ?(?:dot|DOT) ?[\])] ?[A-Za-z0-9-]{1,63}|\.[A-Za-z0-9-]{1,63})+")),
    ("phone", re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])")),
    ("phone", re.compile(r"(?<![0-9])00[1-9][0-9]?[ .-][0-9]{2,4}(?:[ .-][0-9]{2,4}){2,3}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])[3-6][0-9]{3}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{3,4}(?![0-9])")),
)
_NEAR = re.compile(r"[A-Za-z-]{2,20}")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d += d * (i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the contract's spans, by start and then kind; each scan is linear in the text."""
    out = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and ord(text[start - 1]) < 128 and ord(text[start - 1]) in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), 0))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in m.groups()):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 12 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
            out.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further proposals that overlap no base span and no proposal before them.

    A pattern's matches ascend and do not overlap each other, so one sweep along the spans taken before it is enough.
    """
    out: list[tuple[int, int, int]] = []
    for kind, pattern in _WIDER:
        taken, at, reach, new = sorted([*base, *out]), 0, 0, []
        for m in pattern.finditer(text):
            while at < len(taken) and taken[at][0] < m.end():
                reach = max(reach, taken[at][1])  # the furthest end of all spans that start before this match ends
                at += 1
            if reach <= m.start():
                new.append((m.start(), m.end(), KINDS.index(kind)))
        out += new
    return sorted(out)


def votes(text: str, span: tuple[int, int, int], strict: bool) -> str:
    """One character per labeler: + for, - against, 0 no opinion."""
    a, b, kind = span
    s, before, after = text[a:b], text[max(0, a - 40) : a], text[b : b + 20]
    near = {w.lower() for w in _NEAR.findall(before)[-4:]} | {w.lower() for w in _NEAR.findall(after)[:2]}
    digits = "".join(c for c in s if c.isdigit())
    if kind == 2:
        check = "+" if luhn(digits) else "-"
    elif kind == 1:
        check = "-" if digits.startswith("0") or s.split(".")[0] in ("0", "255") else "+"
    elif kind == 3:
        check = "-" if len(set(digits)) < 3 else "0"
    else:
        check = "0"
    glued = (before[-1:].isalnum() or before[-1:] in "/=#_") if before else False
    layout = "-" if len(digits) > 8 and re.search(r"(\d)\1{5}", digits) else "+" if kind in (0, 1) or re.search(r"[ ().-]", s) or len(digits) in (15, 16) else "0"
    return "".join(("+" if strict else "0", check, "+" if near & CUES else "0", "-" if near & COUNTER_CUES else "0", "-" if glued or after[:1].isalnum() else "+", layout))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and wider spans with their votes; rows as in docs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"].astype("Int64"), pdf["text"]):
                base = base_spans(text := text or "")
                more = candidates(text, base)
                out.append((doc_id, [f"{KINDS[k]}:{a}:{b}" for a, b, k in base], [f"{KINDS[k]}:{a}:{b}" for a, b, k in more], [KINDS[s[2]] + votes(text, s, True) for s in base], [KINDS[s[2]] + votes(text, s, False) for s in more]))
            yield pd.DataFrame(out, columns=["doc_id", "base", "wider", "base_votes", "wider_votes"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, base array<string>, wider array<string>, base_votes array<string>, wider_votes array<string>")


def aggregate(patterns: list[tuple[str, int]], rounds: int = 50) -> dict[str, float]:
    """Chance that a candidate with a vote pattern is real, by expectation-maximisation within its kind."""
    out: dict[str, float] = {}
    for kind in KINDS:
        own = [(p[len(kind) :], n) for p, n in patterns if p.startswith(kind)]
        if not own:
            continue
        x = np.array([["-0+".index(c) for c in p] for p, _ in own])
        n = np.array([c for _, c in own], dtype=float)
        one = np.eye(3)[x]
        chance = np.clip(0.5 + 0.15 * (x - 1).sum(axis=1), 0.05, 0.95)  # the majority to begin with
        for _ in range(rounds):
            prior = ((n * chance).sum() + 1) / (n.sum() + 2)
            table = [((n * r)[:, None, None] * one).sum(axis=0) + [[0.3, 0.5, 0.3 + 2 * good]] + np.array([[2.0 * (not good), 0, 0]]) for r, good in ((1 - chance, False), (chance, True))]
            log = [np.log(t / t.sum(axis=1, keepdims=True)) for t in table]
            no, yes = (np.log(q) + (one * g).sum(axis=(1, 2)) for q, g in ((1 - prior, log[0]), (prior, log[1])))
            chance = 1 / (1 + np.exp(np.clip(no - yes, -40, 40)))
        out |= {kind + p: float(c) for (p, _), c in zip(own, chance)}
    return out


def span_features(pattern: str) -> np.ndarray:
    kind = next(k for k in KINDS if pattern.startswith(k))
    marks = pattern[len(kind) :]
    return np.array([1.0, *(k == kind for k in KINDS), *(m == c for m in marks for c in "+-"), marks[2] == "+" and marks[3] == "0", marks[1] == "+" and marks[4] == "+"], dtype=float)


def train(patterns: list[tuple[str, int]], chances: dict[str, float], steps: int = 400, decay: float = 1e-3) -> np.ndarray:
    """Weights of the final span classifier, from the chances as soft labels and the patterns' counts."""
    x = np.stack([span_features(p) for p, _ in patterns])
    n = np.log1p([c for _, c in patterns])
    y, w = np.array([chances[p] for p, _ in patterns]), np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * p * (1 - p) + 1e-6)[:, None]).T @ x / n.sum() + decay * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (n * (p - y)) / n.sum() + decay * w)
        w -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return w


def personal_data(docs: DataFrame, accept: float = 0.5) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of docs; more: n_added."""
    found = written(find(docs), "spans")
    rows = found.select(F.explode(F.concat("base_votes", "wider_votes")).alias("p")).groupBy("p").agg(F.count("*").alias("n")).orderBy("p").collect()
    patterns = [(r["p"], r["n"]) for r in rows]  # a fixed number of patterns at most
    good: list[str] = []
    if patterns:
        w = train(patterns, aggregate(patterns))
        good = [p for p, _ in patterns if float(span_features(p) @ w) >= np.log(accept / (1 - accept))]
    taken = F.transform(F.filter(F.arrays_zip("wider", "wider_votes"), lambda x: x["wider_votes"].isin(good) if good else F.lit(False)), lambda x: x["wider"])
    part = lambda s, i: F.element_at(F.split(s, ":"), i)
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    key = lambda s: F.struct(part(s, 2).cast("long").alias("a"), F.element_at(rank, part(s, 1)).alias("k"), s.alias("s"))
    every = F.transform(F.array_sort(F.transform(F.concat("base", taken), key)), lambda x: x["s"])
    count = lambda k: F.size(F.filter("base", lambda s: s.startswith(k + ":"))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(F.concat_ws(",", "base").cast("binary"), 256).alias("base_sha256"), F.concat_ws(",", every).alias("spans"), F.size(taken).cast("long").alias("n_added"))
