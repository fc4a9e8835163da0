"""Personal data: fixed base patterns, and further spans by weak supervision.

Base spans (e-mail, IP address, card number, phone number) are always reported. Further
candidates (secrets, local phone numbers, account and national numbers, spelled-out
addresses) are judged by labelers that may vote for, against or not at all: the strict
pattern (regex), word and number lists (gazetteer) and the words before the span (context).
Expectation-maximisation over all votes estimates how reliable each labeler is and how
likely each pattern of votes is personal data; these soft labels train the final span
classifier, a logistic regression on votes and shape, whose verdict counts.

Texts are scanned once. Every candidate carries a signature, its kind, votes and coarse
shape, of which there are a bounded number; counts of signatures over all documents, not
the spans, reach the driver, so both models learn from the whole corpus.

Defined cases: null texts are empty. Texts of any length are scanned in linear time. Spans
of one kind do not overlap; a candidate that overlaps a base span is dropped. Repeated rows
get equal spans. Without candidates no model is fitted and the base spans stand alone.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hookloom.llm.common import whole_text
from hookloom.session import stage_table

KINDS = ("email", "ip", "card", "phone", "secret", "local_phone", "account", "national_id", "spelled_email")
BASE_KINDS = 4

LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match starts at the first digit of a run, so the look behind only saves retries.
ADDRESS = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGITS = re.compile(r"[^0-9]+")

ASSIGNED = re.compile(r"[:=][\x20\t]*[\"']?([^\s\"']{8,})")
CLOUD_KEY = re.compile(r"(?<![A-Z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])")
LOCAL_PHONE = re.compile(r"(?<![0-9+)(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9-])")
ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
SPELLED = re.compile(
    r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++"
    r"(?:\x20?(?:[(\[]dot[)\]]|\.)\x20?[A-Za-z0-9-]++)+"
)

# Words of the labelers' lists.
SECRET_WORDS = re.compile(
    r"(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential)s?"
    r"[\"']?[\x20\t]*$", re.IGNORECASE,
)
CUES = {
    "secret": re.compile(r"password|passwd|secret|token|key|login|credential|auth", re.IGNORECASE),
    "local_phone": re.compile(r"phone|tel|call|mobile|fax|cell|contact", re.IGNORECASE),
    "account": re.compile(r"iban|account|konto|compte|cuenta|bank", re.IGNORECASE),
    "national_id": re.compile(r"ssn|social|security|insurance|national|identity|taxpayer", re.IGNORECASE),
    "spelled_email": re.compile(r"mail|contact|write|reach|address", re.IGNORECASE),
}
COUNTER_CUES = re.compile(
    r"version|isbn|issn|doi|figure|table|page|section|order|item|model|serial|example|hash|commit|http", re.IGNORECASE
)
SECRET_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk_live_", "sk-", "xoxb-", "xoxp-", "AIza", "eyJ")
ACCOUNT_LANDS = frozenset("AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MT NL NO PL PT RO SE SI SK".split())
MAIL_ENDINGS = frozenset("com org net edu gov io de fr es it uk eu info biz co".split())


def email_spans(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from each @ outward."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, kind and end of the base spans, in order."""
    spans = [(start, 0, end) for start, end in email_spans(text)] if "@" in text else []
    if DIGIT.search(text):
        for match in ADDRESS.finditer(text) if text.count(".") > 2 else ():
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in match.groups()):
                spans.append((match.start(), 1, match.end()))
        for match in CARD.finditer(text):
            if match.end() - match.start() >= 14:
                digits = NOT_DIGITS.sub("", match.group())
                if 14 <= len(digits) <= 19 and luhn(digits):
                    spans.append((match.start(), 2, match.end()))
        for match in PHONE.finditer(text) if "+" in text else ():
            if 10 <= len(NOT_DIGITS.sub("", match.group())) <= 15:
                spans.append((match.start(), 3, match.end()))
    return sorted(spans)


def candidates(text: str) -> Iterator[tuple[int, int, int]]:
    """Start, kind and end of what further personal data might be; of each kind without overlap."""
    if "=" in text or ":" in text:
        for match in ASSIGNED.finditer(text):
            if SECRET_WORDS.search(text[max(0, match.start() - 32):match.start()]):
                yield match.start(1), 4, match.end(1)
    if "AKIA" in text or "ASIA" in text:
        for match in CLOUD_KEY.finditer(text):
            yield match.start(), 4, match.end()
    if DIGIT.search(text):
        for kind, pattern in ((5, LOCAL_PHONE), (6, ACCOUNT), (7, NATIONAL)):
            for match in pattern.finditer(text):
                yield match.start(), kind, match.end()
    if "at)" in text or "at]" in text:
        for match in SPELLED.finditer(text):
            yield match.start(), 8, match.end()


def strict_vote(kind: str, span: str) -> int:
    digits = NOT_DIGITS.sub("", span)
    if kind == "secret":
        classes = sum(bool(re.search(part, span)) for part in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
        return 1 if classes >= 2 and len(set(span)) >= 6 else -1
    if kind == "local_phone":
        return 1 if digits[0] in "23456789" and digits[3] in "23456789" else -1
    if kind == "account":
        plain = span.replace(" ", "")
        moved = "".join(str(int(char, 36)) for char in plain[4:] + plain[:4])
        return 1 if int(moved) % 97 == 1 else -1
    if kind == "national_id":
        return -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" else 1
    return 1


def list_vote(kind: str, span: str) -> int:
    if kind == "secret":
        return 1 if span.startswith(SECRET_PREFIXES) or re.fullmatch(r"[0-9a-fA-F]{16,}", span) else 0
    if kind == "local_phone":
        return -1 if len(set(NOT_DIGITS.sub("", span))) <= 2 else 0
    if kind == "account":
        return 1 if span[:2] in ACCOUNT_LANDS else -1
    if kind == "national_id":
        return -1 if span in ("123-45-6789", "078-05-1120") else 0
    return 1 if re.split(r"[^A-Za-z]+", span)[-1].lower() in MAIL_ENDINGS else 0


def context_vote(kind: str, before: str) -> int:
    if CUES[kind].search(before):
        return 1
    return -1 if COUNTER_CUES.search(before) else 0


LABELERS = 3


def signature(text: str, start: int, kind: int, end: int) -> str:
    """Kind, votes and coarse shape of a candidate."""
    span, before, name = text[start:end], text[max(0, start - 40):start], KINDS[kind]
    votes = strict_vote(name, span), list_vote(name, span), context_vote(name, before)
    size = min(int(math.log2(len(span))), 6)
    share = 4 * sum(char.isdigit() for char in span) // len(span)
    return ":".join(map(str, (kind, *votes, size, share)))


def scan(text: str) -> tuple[list[dict], list[dict]]:
    """Base spans, and the candidates that do not overlap them, with their signatures."""
    base = base_spans(text)
    taken: list[list[int]] = []  # base spans, merged
    for start, _, end in base:
        if taken and start < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], end)
        else:
            taken.append([start, end])
    further, reach = [], {}
    for start, kind, end in sorted(candidates(text)):
        before = bisect.bisect_left(taken, [end]) - 1  # the last that starts before the candidate ends
        if start < reach.get(kind, 0) or (before >= 0 and taken[before][1] > start):
            continue
        reach[kind] = end
        further.append({"start": start, "kind": kind, "end": end, "signature": signature(text, start, kind, end)})
    return [{"start": start, "kind": kind, "end": end} for start, kind, end in base], further


SCANNED = (
    "base array<struct<start int, kind int, end int>>, "
    "further array<struct<start int, kind int, end int, signature string>>"
)


def scanned(text: Column) -> Column:
    @F.pandas_udf(SCANNED)
    def scan_all(texts: pd.Series) -> pd.DataFrame:
        found = [scan(content) for content in texts]
        return pd.DataFrame({"base": [base for base, _ in found], "further": [further for _, further in found]})

    return scan_all(whole_text(text))


def estimate_votes(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each vote pattern being personal data, and the labelers' vote tables.

    Two latent classes; each labeler has for each class its own chance of each vote. The start
    trusts every labeler somewhat, and one pseudo-count per cell keeps tables proper.
    """
    posterior = 1 / (1 + np.exp(-votes.sum(axis=1)))
    for _ in range(rounds):
        weight = np.stack([(1 - posterior) * counts, posterior * counts])
        prior = (weight.sum(axis=1) + 1) / (weight.sum() + 2)
        tables = np.ones((2, votes.shape[1], 3))
        for labeler, vote in product(range(votes.shape[1]), (-1, 0, 1)):
            tables[:, labeler, vote + 1] += weight[:, votes[:, labeler] == vote].sum(axis=1)
        tables /= tables.sum(axis=2, keepdims=True)
        chance = np.log(prior)[:, None] + sum(
            np.log(tables[:, labeler, votes[:, labeler] + 1]) for labeler in range(votes.shape[1])
        )
        updated = 1 / (1 + np.exp(np.clip(chance[0] - chance[1], -50, 50)))
        if np.abs(updated - posterior).max() < 1e-6:
            posterior = updated
            break
        posterior = updated
    return posterior, tables


def signature_features(parts: np.ndarray) -> np.ndarray:
    """Indicator features of signatures: kind, each vote, length and share of digits."""
    columns = [parts[:, 0] == kind for kind in range(BASE_KINDS, len(KINDS))]
    for labeler in range(1, 1 + LABELERS):
        columns += [parts[:, labeler] == vote for vote in (-1, 1)]
    columns += [parts[:, -2] >= size for size in (3, 4, 5)]
    columns += [parts[:, -1] >= share for share in (1, 2, 4)]
    columns.append(np.ones(len(parts), dtype=bool))
    return np.stack(columns, axis=1).astype(float)


def train_classifier(features: np.ndarray, truth: np.ndarray, counts: np.ndarray, steps: int = 50) -> np.ndarray:
    """Logistic regression on soft labels, by Newton steps with a small penalty."""
    weights, share = np.zeros(features.shape[1]), counts / counts.sum()
    for _ in range(steps):
        chance = 1 / (1 + np.exp(-np.clip(features @ weights, -30, 30)))
        slope = features.T @ (share * (chance - truth)) + 1e-3 * weights
        curve = (features * (share * chance * (1 - chance))[:, None]).T @ features + 1e-3 * np.eye(len(weights))
        step = np.linalg.solve(curve, slope)
        weights -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return weights


def accepted_signatures(counts: pd.DataFrame, threshold: float = 0.5) -> list[str]:
    """Signatures that the span classifier takes for personal data."""
    if counts.empty:
        return []
    counts = counts.sort_values("signature", ignore_index=True)
    parts = np.array([[int(part) for part in text.split(":")] for text in counts["signature"]])
    sizes = counts["n"].to_numpy(dtype=float)
    posterior, _ = estimate_votes(parts[:, 1:1 + LABELERS], sizes)
    features = signature_features(parts)
    weights = train_classifier(features, posterior, sizes)
    return counts["signature"][1 / (1 + np.exp(-features @ weights)) >= threshold].tolist()


def find_personal_data(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """One row per document: ``row`` (the carried columns), ``base`` and ``spans``, arrays of
    ``start``, ``kind`` (index into KINDS) and ``end`` in code points, in order.
    """
    rows = docs.select(
        F.struct(*(F.col(f"`{name}`") for name in carry)).alias("row"), scanned(F.col(f"`{text}`")).alias("found")
    ).select("row", "found.base", "found.further")
    rows = stage_table(rows, "pii-rows")
    counts = rows.select(F.explode("further.signature").alias("signature")) \
        .groupBy("signature").agg(F.count("*").alias("n")).toPandas()
    accepted = accepted_signatures(counts)
    plain = "array<struct<start:int,kind:int,end:int>>"
    added = F.transform(
        F.filter("further", lambda span: span["signature"].isin(accepted) if accepted else F.lit(False)),
        lambda span: F.struct(span["start"], span["kind"], span["end"]),
    ).cast(plain)
    return rows.select("row", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of spans in order, comma-joined."""
    names = F.array(*(F.lit(name) for name in KINDS))
    return F.array_join(F.transform(
        spans, lambda span: F.concat_ws(":", names[span["kind"]], span["start"], span["end"])
    ), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """Counts and spans of every document."""
    found = find_personal_data(docs, ["doc_id"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *(F.size(F.filter("base", _is(kind))).cast("long").alias(f"n_{KINDS[kind]}") for kind in range(BASE_KINDS)),
        F.sha2(span_list(F.col("base")), 256).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
    )


def _is(kind: int):
    return lambda span: span["kind"] == kind
