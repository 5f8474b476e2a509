"""Operator 5: personal data by weak supervision over regex, gazetteer and context labelers."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, map_text

KINDS = ("email", "ip", "card", "phone", "secret")

#: The base patterns. A look-behind and possessive counts only save useless retries;
#: they match what the plain forms match.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT = re.compile("[0-9]")

#: Gazetteers: words that announce a kind, and words after which digits are no personal data.
ANNOUNCE = {
    "email": frozenset(("mail", "email", "e-mail", "contact", "write", "address", "correo", "courriel")),
    "ip": frozenset(("ip", "host", "server", "address", "from", "login")),
    "card": frozenset(("card", "visa", "mastercard", "credit", "debit", "account", "karte", "tarjeta", "carte")),
    "phone": frozenset(("call", "phone", "tel", "telephone", "fax", "mobile", "cell", "telefon", "teléfono", "téléphone")),
    "secret": frozenset(("password", "passwd", "pwd", "secret", "token", "key", "apikey", "api_key", "credential")),
}
HARMLESS = frozenset(("version", "license", "licence", "section", "chapter", "page", "isbn", "issn", "doi", "no", "figure", "table"))
ENDINGS = frozenset(("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info"))

#: Candidates beyond the base: kind and a pattern that is broad on purpose. The votes decide.
BROAD = (
    ("email", "[at]", re.compile(r"(?<![\w.+%-])[\w.+%-]++ ?(?:\[at\]|\(at\)|@) ?[\w-]+(?: ?(?:\[dot\]|\(dot\)|\.) ?[\w-]+)+")),
    ("email", "at", re.compile(r"(?<![\w.+%-])[\w.+%-]++ ?(?:\[at\]|\(at\)| at ) ?[\w-]+(?: ?(?:\[dot\]|\(dot\)| dot ) ?[\w-]+)+", re.I)),
    ("phone", "0", re.compile(r"(?<![\w+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])")),
    ("card", "0", re.compile(r"(?<![\w.-])[0-9](?:[ -]?[0-9]){11,18}(?![\w-])")),
    ("ip", ":", re.compile(r"(?<![\w:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![\w:])")),
    ("secret", "=", re.compile(r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[\w+/.-]{6,}[\"']?")),
    ("secret", "0", re.compile(r"(?<![\w+/=-])(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{16,}+(?![\w+/=-])")),
)

SECRET_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "sk_", "xoxb-", "AIza", "eyJ")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(DIGIT.findall(s))


def base_emails(text: str) -> list[tuple[int, int]]:
    """The email pattern's matches, found from each @ outwards: linear in the text."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start, then by kind as listed."""
    found = [(s, e, 0) for s, e in base_emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append((m.start(), m.end(), 1))
        for m in CARD.finditer(text):
            if m.end() - m.start() <= 37 and 12 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
                found.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(digits_of(m.group())) <= 15:
                    found.append((m.start(), m.end(), 3))
    found.sort(key=lambda x: (x[0], x[2], x[1]))
    return [(s, e, KINDS[k]) for s, e, k in found]


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans of the broad patterns that touch no base span and no earlier candidate."""
    digit, found, lowered = DIGIT.search(text) is not None, [], None
    taken = bytearray(len(text))
    for s, e, _ in base:
        taken[s:e] = b"\1" * (e - s)
    address = "@" in text or "[at]" in text or "(at)" in text
    for kind, needs, pattern in BROAD:
        if needs == "0":
            if not digit:
                continue
        elif needs == "[at]":
            if not address:
                continue
        elif needs == "at":
            lowered = text.lower() if lowered is None else lowered
            if "dot" not in lowered:
                continue
        elif needs not in text and not (needs == "=" and ":" in text):
            continue
        for m in pattern.finditer(text):
            if taken.find(1, m.start(), m.end()) < 0:
                found.append((m.start(), m.end(), kind))
                taken[m.start() : m.end()] = b"\1" * (m.end() - m.start())
    return sorted(found)


def describe(text: str, span: tuple[int, int, str], is_base: bool) -> tuple[str, str]:
    """A span's votes, a character - (no), 0 (abstains) or + (yes) per labeler, and its features.

    Labelers: the base pattern; a check of form (checksum, counts, known endings); a gazetteer of
    announcing words before; a gazetteer of well-known starts; the mix of characters; the harmless
    context. Features are the classifier's: kind and discrete classes of shape and context, never
    the base pattern's own vote.
    """
    start, end, kind = span
    s = text[start:end]
    digits, n = digits_of(s), len(s)
    before = re.findall(r"[\w-]+", text[max(0, start - 40) : start].lower())[-3:]
    announced = any(w in ANNOUNCE[kind] for w in before) or kind == "secret" and re.match(r"(?i)pass|pwd|secret|token|api", s) is not None
    harmless = bool(before) and before[-1] in HARMLESS
    if kind == "email":
        form = 1 if re.split(r"\W+", s.lower().rstrip(")]"))[-1] in ENDINGS else 0
        start_known, mixed = 0, "@" in s or "at" in s.lower()
    elif kind == "ip":
        form = 1 if s.count(":") == 7 or s.count(".") == 3 else -1
        start_known, mixed = 0, 7 <= n
    elif kind == "card":
        form = 1 if luhn(digits) else -1
        start_known, mixed = (1 if digits[:1] in ("3", "4", "5", "6") else -1), len(digits) in (13, 14, 15, 16, 19)
    elif kind == "phone":
        form = 1 if 9 <= len(digits) <= 15 else -1
        start_known, mixed = (1 if s.startswith("+") else 0), n > len(digits)
    else:
        body = re.split(r"[=:]\s*", s)[-1].strip("\"'")
        form = 1 if len(body) >= 16 else 0
        start_known = 1 if body.startswith(SECRET_STARTS) else 0
        share = len(digits_of(body)) / max(1, len(body))
        mixed = 0.1 <= share <= 0.9 and not re.fullmatch(r"[a-zA-Z]+[0-9]{1,4}|[0-9-]+", body)
    votes = (1 if is_base else 0, form, int(announced), start_known, 1 if mixed else -1, -1 if harmless else 0)
    feature = (kind, f"form{form}", f"start{start_known}", f"mixed{int(mixed)}", f"said{int(announced)}", f"harmless{int(harmless)}", f"long{min(3, n // 12)}")
    return "".join("-0+"[v + 1] for v in votes), "|".join(feature)


@dataclass(frozen=True)
class Model:
    """Weights of the final span classifier by feature, with its threshold."""

    weights: dict[str, float]
    threshold: float = 0.5

    def keeps(self, feature: str) -> bool:
        z = self.weights.get("bias", 0.0) + sum(self.weights.get(f, 0.0) for f in feature.split("|"))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35))) >= self.threshold


def reliabilities(votes: list[str], counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Posterior that each vote pattern marks personal data, by expectation-maximisation.

    Labelers are independent given the truth; each has its own chances of -, 0 and +. Pseudo-counts
    hold a labeler better than chance, so that the two classes cannot swap. Starts from the sum of
    votes. The patterns are at most 3 ** labelers, whatever the corpus.
    """
    v = np.array([["-0+".index(c) for c in x] for x in votes])
    p = 1 / (1 + np.exp(-1.5 * (v - 1).sum(1)))
    prior = np.array([[3.0, 2.0, 1.0], [1.0, 2.0, 3.0]])  # rows: not personal, personal
    for _ in range(rounds):
        total = np.log(np.array([((1 - p) * counts).sum() + 1, (p * counts).sum() + 1]))
        log = np.repeat(total[None, :], len(v), 0)
        for j in range(v.shape[1]):
            for y, weight in enumerate((1 - p, p)):
                chance = prior[y] + np.bincount(v[:, j], weights=weight * counts, minlength=3)
                log[:, y] += np.log(chance / chance.sum())[v[:, j]]
        p = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -35, 35)))
    return p


def fit_model(rows: list[tuple[str, str, int]], threshold: float = 0.5) -> Model:
    """rows: distinct (votes, feature, count). EM gives soft labels, logistic regression fits them."""
    if not rows:
        return Model({"bias": -1.0}, threshold)
    counts = np.array([r[2] for r in rows], float)
    kinds = [r[1].split("|")[0] for r in rows]
    p = np.zeros(len(rows))
    for kind in set(kinds):
        own = [i for i, k in enumerate(kinds) if k == kind]
        p[own] = reliabilities([rows[i][0] for i in own], counts[own])
    names = sorted({f for r in rows for f in r[1].split("|")})
    x = np.array([[1.0] + [float(f in r[1].split("|")) for f in names] for r in rows])
    weight = np.sqrt(counts) / np.sqrt(counts).sum()  # a frequent form does not drown the others
    w = np.zeros(x.shape[1])
    for _ in range(2000):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        w -= 2.0 * (x.T @ (weight * (q - p)) + 1e-4 * w)
    return Model({"bias": float(w[0])} | dict(zip(names, w[1:].tolist(), strict=True)), threshold)


def learn(docs: DataFrame, threshold: float = 0.5) -> Model:
    """A model from the votes on all candidate and base spans of all texts.

    Each task counts its distinct (votes, feature) pairs; their number is bounded by the labelers'
    and features' values (under 3**6 * 5 * 2000), in practice some hundred rows.
    """
    schema = "votes string, feature string, n long"

    def run(batches):
        from collections import Counter

        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    base = base_spans(text)
                    seen.update(describe(text, x, True) for x in base)
                    seen.update(describe(text, x, False) for x in candidates(text, base))
        rows = list(seen.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())],
            names=["votes", "feature", "n"],
        )

    got = docs.select("text").mapInArrow(run, schema).groupBy("votes", "feature").agg(F.sum("n").alias("n")).collect()
    return fit_model(sorted((r["votes"], r["feature"], r["n"]) for r in got), threshold)


def all_spans(text: str, model: Model) -> tuple[list, list]:
    """Base spans, and base and added spans, each (start, end, kind) by start, then kind as listed."""
    base = base_spans(text)
    more = [x for x in candidates(text, base) if model.keeps(describe(text, x, False)[1])]
    return base, sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def find_private(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_spans.

    Null and empty texts have no spans. Nulls in doc_id and repeated rows stay; other columns are
    dropped; positions count code points, ends are exclusive.
    """

    def compute(texts: list[str]) -> dict[str, object]:
        found = [all_spans(x, model) for x in texts]
        spell = lambda spans: ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
        out: dict[str, object] = {f"n_{k}": [sum(x[2] == k for x in b) for b, _ in found] for k in KINDS[:4]}
        out["base_sha256"] = [hashlib.sha256(spell(b).encode()).hexdigest() for b, _ in found]
        out["spans"] = [spell(a) for _, a in found]
        out["n_spans"] = [len(a) for _, a in found]
        return out

    fields = [(f"n_{k}", T.LongType()) for k in KINDS[:4]]
    fields += [("base_sha256", T.StringType()), ("spans", T.StringType()), ("n_spans", T.LongType())]
    return map_text(docs, compute, fields)


def mask_text(text: str, model: Model) -> str:
    """The text with each span, overlapping ones as one, put as its (first) kind in angle brackets."""
    out, free = [], 0
    for start, end, kind in all_spans(text, model)[1]:
        if start >= free:
            out += [text[free:start], f"<{kind.upper()}>"]
        free = max(free, end)
    return "".join([*out, text[free:]]) if out else text


def mask_private(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with masked texts; all columns and rows stay, null texts are null."""
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            masked = [x and mask_text(x, model) for x in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(masked, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op5_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return find_private(docs, learn(docs))
