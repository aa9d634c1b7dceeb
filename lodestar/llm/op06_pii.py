"""Personal data by weak supervision.

Candidates: the four base kinds (email, ip, card, phone), which always stay, and loose ones that need a verdict
(national phone numbers, spelled-out e-mail addresses, social security and account numbers).  Labelers vote on each
candidate, 1 for, 0 against or none: the regular expression's own checks, a gazetteer (top-level domains, calling
codes, issuer prefixes, country codes) and the words around it.  Votes and span features take few values, so whole
tables reduce to counts per pattern (bounded by the product of their values, not by the data).  Expectation
maximisation over those counts estimates each labeler's accuracy for each kind and the probability of every pattern;
a logistic regression on all span features is trained on these probabilities, weighted by counts, and decides.

Null text has no spans.  Every row is found by itself; repeated rows yield repeated results.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import pieces, python_ready, text_of

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "ssn", "iban")
# Well-known top-level domains, calling codes, country codes and cue words.
DOMAINS = frozenset("com org net edu gov io info biz example test de fr es it nl uk us ca eu ch at be pl se no dk fi pt ie au nz jp cn in br mx".split())
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "64", "81", "82", "86", "91", "351", "353", "358")
COUNTRIES = frozenset("AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MT NL NO PL PT RO SE SI SK".split())
FOR = re.compile(r"e-?mail|mail|contact|tel|phone|call|mobile|fax|card|visa|credit|iban|account|konto|ssn|social security|\bip\b|host|server|address|adresse|correo|courriel", re.I)
AGAINST = re.compile(r"version|isbn|issn|order no|ref|invoice|chapter|section|pages?\b|\bno\.|figure|release", re.I)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NATIONAL = re.compile(r"(?<![0-9+.(-])(?:\([0-9]{2,4}\)[ ]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9-])")
_SPELLED = re.compile(r"[A-Za-z0-9_.+-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z]{2,10}){1,3}")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        value = int(d) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the longest run of local characters before an @ that a domain follows."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, last := m.end()))
        else:
            last = max(last, at + 1)  # no match can hold this @; what follows it may still begin one
        at = text.find("@", max(at + 1, last))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of the four base kinds, in order."""
    spans = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if any(map(text.__contains__, "0123456789")):
        spans += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split("."))] if "." in text else []
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
        if "+" in text:
            spans += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(spans)


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates that overlap no base span nor one another."""
    found = []
    if any(map(text.__contains__, "0123456789")):
        found += [(m.start(), 3, m.end()) for m in _NATIONAL.finditer(text)] + [(m.start(), 4, m.end()) for m in _SSN.finditer(text)] + [(m.start(), 5, m.end()) for m in _IBAN.finditer(text)]
    if "(at)" in text or "[at]" in text:
        found += [(m.start(), 0, m.end()) for m in _SPELLED.finditer(text)]
    out: list[tuple[int, int, int]] = []
    if found:
        taken = sorted((a, b) for a, _, b in base)
        for a, k, b in sorted(found, key=lambda s: (s[0], -s[2])):
            if all(b <= x or a >= y for x, y in taken) and (not out or a >= out[-1][2]):
                out.append((a, k, b))
    return out


def pattern(text: str, span: tuple[int, int, int], base: bool) -> tuple[int, ...]:
    """kind, base, votes of the three labelers (2: none), and span features, each of a few values."""
    start, kind, end = span
    value = text[start:end]
    digits = "".join(c for c in value if c.isdigit())
    if kind == 0:
        rule, listed = int("@" in value), int(re.split(r"[^A-Za-z0-9]+", value)[-1].lower() in DOMAINS)
    elif kind == 1:
        rule, listed = 1, int(not value.startswith(("0.", "127.", "255.")))
    elif kind == 2:
        rule, listed = int(luhn(digits)), int(digits[0] in "3456")
    elif kind == 3:
        rule, listed = int(base) if base or len(digits) < 9 else 2, int(digits.startswith(CALLING)) if value[0] == "+" else 2
    elif kind == 4:
        rule, listed = int(digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"), 2
    else:
        turned = value.replace(" ", "")
        turned = turned[4:] + turned[:4]
        rule, listed = int(int("".join(str(int(c, 36)) for c in turned)) % 97 == 1), int(value[:2] in COUNTRIES)
    around = text[max(0, start - 40) : start] + " " + text[end : end + 20]
    context = 0 if AGAINST.search(around) else 1 if FOR.search(around) else 2
    same = int(len(set(digits)) <= 2) if digits else 0
    return kind, int(base), rule, listed, context, min(len(value) // 6, 4), min(sum(not c.isalnum() for c in value), 4), same


def label_model(patterns: dict[tuple[int, ...], int], rounds: int = 50) -> dict[tuple[int, ...], float]:
    """Probability of each pattern, by EM with one accuracy table for each kind and labeler."""
    out: dict[tuple[int, ...], float] = {}
    for kind in sorted({p[0] for p in patterns}):
        own = sorted(p for p in patterns if p[0] == kind)
        count = np.array([patterns[p] for p in own], float)
        votes = np.array([p[2:5] for p in own])
        belief = np.clip(np.where(votes == 2, 0.5, votes).mean(axis=1), 0.05, 0.95)  # starts at the majority
        for _ in range(rounds):
            yes, no = count * belief, count * (1 - belief)
            prior = (yes.sum() + 1) / (count.sum() + 2)
            score = np.full(len(own), np.log(prior / (1 - prior)))
            for k in range(votes.shape[1]):
                for v in (0, 1):
                    hit = votes[:, k] == v
                    right, wrong = (yes[hit].sum() + 1 + v) / (yes[votes[:, k] < 2].sum() + 3), (no[hit].sum() + 2 - v) / (no[votes[:, k] < 2].sum() + 3)
                    score[hit] += np.log(right / wrong)
            belief = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        out |= dict(zip(own, belief.tolist(), strict=True))
    return out


def _features(p: tuple[int, ...]) -> np.ndarray:
    x = np.zeros(64)
    x[0] = 1
    x[1 + p[0]] = 1
    for k, v in enumerate(p[1:]):
        x[8 + 6 * k + min(v, 5)] = 1
    return x


def span_classifier(patterns: dict[tuple[int, ...], int], belief: dict[tuple[int, ...], float], rounds: int = 300) -> np.ndarray:
    """Logistic regression on soft labels, each pattern weighted by the logarithm of its count."""
    own = sorted(patterns)
    if not own:
        return np.zeros(64)
    x, y = np.stack([_features(p) for p in own]), np.array([belief[p] for p in own])
    w = np.log1p(np.array([patterns[p] for p in own], float))
    w /= w.sum()
    theta = np.zeros(x.shape[1])
    for _ in range(rounds):
        theta -= 4.0 * (x.T @ (w * (1 / (1 + np.exp(-x @ theta)) - y)) + 1e-4 * theta)
    return theta


def accepts(theta: np.ndarray, p: tuple[int, ...]) -> bool:
    return bool(_features(p) @ theta > 0)


def train(docs: DataFrame) -> np.ndarray:
    """Counts of patterns over all texts, then the two models.  What comes to the driver has a row for each pattern."""
    source = docs.select(text_of().alias("pi_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                base = base_spans(text)
                seen.update(pattern(text, s, True) for s in base)
                seen.update(pattern(text, s, False) for s in loose_spans(text, base))
        keys = sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in keys], pa.list_(pa.int64())), pa.array([seen[k] for k in keys], pa.int64())], ["pattern", "n"])

    rows = source.mapInArrow(count, "pattern array<bigint>, n bigint").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    patterns = {tuple(r["pattern"]): r["n"] for r in rows}
    return span_classifier(patterns, label_model(patterns))


def find(docs: DataFrame, theta: np.ndarray | None = None) -> DataFrame:
    """doc_id; counts of the base kinds; base_sha256 of the base spans; spans (all, as kind:start:end joined by
    commas, by start and then kind)."""
    python_ready(docs.sparkSession)
    theta = train(docs) if theta is None else theta
    source = docs.select("doc_id", text_of().alias("pi_text"))
    id_type = source.schema[0].dataType.simpleString()
    joined = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "pi_text"):
                counts, digests, spans = [[], [], [], []], [], []
                for text in part.column("pi_text").to_pylist():
                    base = base_spans(text)
                    more = [s for s in loose_spans(text, base) if accepts(theta, pattern(text, s, False))]
                    for kind in range(4):
                        counts[kind].append(sum(k == kind for _, k, _ in base))
                    digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                    spans.append(joined(sorted(base + more)))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(spans)], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return source.mapInArrow(run, f"doc_id {id_type}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def redact(docs: DataFrame, theta: np.ndarray | None = None) -> DataFrame:
    """docs with every span replaced by its kind in brackets.  Same columns; null text stays null."""
    python_ready(docs.sparkSession)
    theta = train(docs) if theta is None else theta
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, text in enumerate(texts):
                if text:
                    base = base_spans(text)
                    out, left = [], 0
                    for a, k, b in sorted(base + [s for s in loose_spans(text, base) if accepts(theta, pattern(text, s, False))]):
                        if b > left:
                            out += [text[left:a], f"[{KINDS[k].upper()}]"] if a >= left else []
                            left = b
                    texts[i] = "".join([*out, text[left:]])
            columns = batch.columns
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.mapInArrow(run, schema)
