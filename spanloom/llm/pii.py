"""PII: regex, gazetteer and context labellers vote on spans; EM weighs them; a classifier decides.

1. One pass over whole texts finds spans. The base kinds (email, ip, card, phone) follow fixed
   rules and always stay. Further candidates are secrets, national ids, account numbers, local
   phone numbers, and three wide kinds that are often wrong: bare digit runs, long mixed tokens
   and pairs of capitalised words that begin with a given name or follow a title.
2. Six labellers vote for or against every span, base spans included, or abstain: the strict
   pattern of its kind, gazetteers (issuers, country codes, key prefixes, top-level domains, given
   names), cue and counter-cue words before it, a checksum or range rule, the variety of its
   characters, and whether it stands free of other letters.
3. EM over the counts of (kind, vote pattern), at most 11 x 3^6 of which reach the driver,
   estimates every labeller's reliability per kind, and posteriors.
4. A bounded sample of spans (``sample_spans``) trains a logistic classifier on votes by kind and
   span shape with these posteriors as targets. Candidates it accepts are added, others dropped.

Defined results: null text is empty; texts without spans have zero counts and the hash of the
empty string; repeated rows give repeated result rows, ids play no part; very long texts are read
whole, in time linear in their length but for the sorting of their spans; an empty table gives an
empty table; extra columns are ignored by :func:`find` and kept, whatever their names, by
:func:`redact`.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import documents, id_text, materialize, same
from .weak_labels import code, decode, estimate_by_kind, reliability

BASE = ("email", "ip", "card", "phone")
MORE = ("secret", "national_id", "account", "phone_like", "number", "key", "name")
KINDS = BASE + MORE
#: Kinds whose pattern says little: without a gazetteer or cue hit, those labellers vote against.
WIDE = ("number", "key", "name")
LABELLERS = ("pattern", "gazetteer", "context", "checksum", "variety", "isolation")
#: Cue words by kind, in lower case, and words that speak against any kind.
CUES = {
    "email": ("mail", "contact", "write to"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile"),
    "secret": ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "api-key", "key"),
    "national_id": ("ssn", "social security", "national id", "tax id"),
    "account": ("iban", "account", "bank"),
    "phone_like": ("phone", "call", "tel", "mobile", "fax"),
    "number": ("phone", "call", "tel", "mobile", "fax", "account", "passport", "ssn", "tax id", "licence no", "license no"),
    "key": ("password", "passwd", "pwd", "token", "secret", "api key", "apikey", "credential", "bearer"),
    "name": ("name", "contact", "signed", "mr", "mrs", "ms", "dr", "prof", "patient", "employee", "dear", "regards"),
}
COUNTER = ("version", "isbn", "issn", "doi", "order", "part no", "page", "section", "figure", "table", "commit", "sha", "checksum", "model", "example")
#: The gazetteers. First digits of card issuers, country calling codes, countries of
#: account numbers, beginnings of service keys, top-level domains and given names.
ISSUERS = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "36", "38", "6011", "65", "35", "62")
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "351", "352", "353", "358", "370", "371", "372", "380", "420", "421", "852", "886", "971", "972")
COUNTRIES = frozenset("AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IL IS IT LI LT LU LV MC MT NL NO PL PT RO SA SE SI SK SM TR".split())
PREFIXES = ("sk_", "pk_", "sk-", "ghp_", "gho_", "AKIA", "ASIA", "AIza", "xoxb", "xoxp", "eyJ", "glpat-", "SG.", "npm_")
DOMAINS = frozenset("com org net edu gov mil int io co uk us de fr es it nl be at ch se no dk fi pl cz pt ie eu ca au nz jp cn in br mx ar ru info biz me dev app test example".split())
GIVEN = frozenset(
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica "
    "Thomas Sarah Charles Karen Christopher Lisa Daniel Nancy Matthew Sandra Anthony Ashley Mark Emily Paul Donna Steven "
    "Michelle Andrew Carol Kenneth Amanda George Melissa Alice Anna Peter Laura Emma Hans Klaus Jürgen Wolfgang Uwe Heike "
    "Sabine Ursula Monika Petra Jean Pierre Michel Marie Nathalie Isabelle Sophie Camille Luc Julien José Antonio Manuel "
    "Carmen Ana María Juan Carlos Luis Javier Isabel Dolores Pilar Francisco Jorge Ahmed Fatima Wei Li Mei Yuki Hiroshi "
    "Olga Ivan Dmitri Natasha Priya Raj Arjun Ingrid Lars Sven Ada Grace Alan".split()
)
#: Words that make a place or a thing of the given name before them.
THINGS = frozenset("Street Road Avenue Lane Square Park Bay Lake River Island County City Bridge Station Hall House Hospital University College School Institute Center Centre Bank Act Law Period Day Award Prize Church Airport Company".split())
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SECRET = re.compile(r"(?i)\b(?:password|passwd|pwd|token|secret|api[_-]?key)\b\s{0,3}[:=]\s{0,3}[\"']?([^\s\"']{8,})")
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
ACCOUNT = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")
LOCAL_PHONE = re.compile(r"(?<![0-9+])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])")
NUMBER = re.compile(r"(?<![0-9A-Za-z.,+-])[0-9]{9,15}(?![0-9A-Za-z])")
KEY = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{24,}={0,2}")
PAIR = re.compile(r"\b([A-Z][a-zß-ÿ]+)(?= ([A-Z][a-zß-ÿ]+)\b)")
TITLE = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.? \Z")
SPAN = "struct<kind: int, start: int, end: int, votes: int, shape: array<float>>"


@dataclass(frozen=True)
class Fit:
    sample_spans: int = 50_000
    passes: int = 300
    threshold: float = 0.5
    prior: float = 0.6


def emails(text: str):
    """Leftmost, non-overlapping. Found from each @ outwards: no @ stands in a local part, so each
    stretch between two of them is looked at once."""
    at, done = text.find("@"), 0
    while at >= 0:
        size = 64
        while True:  # back to the last character that no local part can hold
            low = max(done, at - size)
            rest = text[low:at].rstrip(LOCAL)
            if rest or low == done:
                break
            size *= 8
        left = low + len(rest)
        right = DOMAIN.match(text, at + 1) if left < at else None
        if right:
            yield left, right.end()
            done = right.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; matches that fail their test are dropped."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not re.search("[0-9]", text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        d = _digits(m[0]) if m.end() - m.start() <= 64 else ""
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


class _Taken:
    """Disjoint stretches of a text, in order."""

    def __init__(self, spans):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def met(self, a: int, b: int) -> slice:
        """Which stretches share a character with [a, b)."""
        return slice(bisect_right(self.ends, a), bisect_left(self.starts, b))

    def add(self, a: int, b: int) -> None:
        at = self.met(a, b)
        low, high = min([a, *self.starts[at]]), max([b, *self.ends[at]])
        self.starts[at], self.ends[at] = [low], [high]


def more_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates outside the base spans: one per place, the first kind that claims it.

    A secret that reaches beyond the spans it meets (digits in a long token can pass for a card)
    stays whole; :func:`redact` covers the spans inside it.
    """
    got: list[tuple[int, int, int]] = []
    if re.search("[0-9=:]", text):
        got += [(4, m.start(1), m.end(1)) for m in SECRET.finditer(text)]
        got += [(5, m.start(), m.end()) for m in NATIONAL.finditer(text)]
        got += [(6, m.start(), m.end()) for m in ACCOUNT.finditer(text)]
        got += [(7, m.start(), m.end()) for m in LOCAL_PHONE.finditer(text)]
        got += [(8, m.start(), m.end()) for m in NUMBER.finditer(text)]
        got += [(9, m.start(), m.end()) for m in KEY.finditer(text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
    for m in PAIR.finditer(text):
        if m[1] in GIVEN or TITLE.search(text, max(0, m.start() - 6), m.start()):
            got.append((10, m.start(), m.end(2)))
    used, out = _Taken((a, b) for _, a, b in taken), []
    for kind, a, b in got:
        met = used.met(a, b)
        inside = any(x <= a and b <= y for x, y in zip(used.starts[met], used.ends[met]))
        if met.start >= met.stop or (kind == 4 and not inside):
            used.add(a, b)
            out.append((kind, a, b))
    return sorted(out)


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _in_gazetteer(name: str, s: str, digits: str) -> bool | None:
    """Whether the lists know the span; None where no list is about its kind."""
    if name == "email":
        return s.rsplit(".", 1)[-1].lower() in DOMAINS
    if name == "card":
        return digits.startswith(ISSUERS)
    if name == "phone":
        return digits.startswith(CALLING)
    if name == "account":
        return s[:2] in COUNTRIES
    if name in ("secret", "key"):
        return s.startswith(PREFIXES) or (None if name == "secret" else False)
    if name == "name":
        return s.split(" ")[0] in GIVEN and s.split(" ")[-1] not in THINGS
    return False if name == "number" else None


def _fits_pattern(name: str, s: str, digits: str) -> bool | None:
    """Whether the span has the strict form of its kind; None where its finder has tested it."""
    if name == "card":
        return len(digits) in (15, 16)
    if name == "secret":
        return bool(digits) and any(c.isalpha() for c in s)
    if name == "number":
        return len(digits) in (9, 10, 11)
    if name == "key":
        return any(c.isupper() for c in s) and any(c.islower() for c in s) and len(digits) >= 4
    return None


def _passes_check(name: str, s: str, digits: str) -> bool | None:
    if name == "account":
        return _iban(s)
    if name == "national_id":
        return s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"
    if name == "ip":
        return all(p == "0" or not p.startswith("0") for p in s.split("."))
    if name in ("phone", "phone_like"):
        return len(set(digits)) > 2
    return None


def judge(text: str, kind: int, a: int, b: int) -> tuple[int, list[float]]:
    """The six votes, coded, and the span's shape."""
    s, before, name = text[a:b], text[max(0, a - 32) : a].lower(), KINDS[kind]
    digits = _digits(s)
    vote = lambda yes: 0 if yes is None else 2 if yes else 1
    cue, against = any(c in before for c in CUES[name]), any(c in before for c in COUNTER)
    context = True if cue and not against else False if against or name in WIDE else None
    variety = len(set(s)) / max(min(len(s), 20), 1)
    free = (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())
    votes = (
        vote(_fits_pattern(name, s, digits)), vote(_in_gazetteer(name, s, digits)), vote(context),
        vote(_passes_check(name, s, digits)), vote(None if name == "name" else variety >= 0.35), vote(free),
    )
    shape = [min(b - a, 200) / 32, len(digits) / max(len(s), 1), variety, float(sum(c.isupper() for c in s)) / max(len(s), 1)]
    return code(votes), shape


def judged_spans(text: str) -> list[dict]:
    """All base spans and candidates of a whole text, judged."""
    base, rows = base_spans(text), []
    for kind, a, b in base + more_spans(text, base):
        votes, shape = judge(text, kind, a, b)
        rows.append({"kind": kind, "start": a, "end": b, "votes": votes, "shape": shape})
    return rows


def _inputs(kind: np.ndarray, votes: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Votes for and against, by kind, then the shape, the kinds and a constant."""
    v, of = decode(votes, len(LABELLERS)), np.eye(len(KINDS))[kind]
    marks = np.concatenate([v == 2, v == 1], axis=1).astype(float)
    by_kind = (of[:, :, None] * marks[:, None, :]).reshape(len(kind), -1)
    return np.concatenate([by_kind, marks, of, shape, np.ones((len(kind), 1))], axis=1)


WIDTH = len(KINDS) * 2 * len(LABELLERS) + 2 * len(LABELLERS) + len(KINDS) + 5


@dataclass
class Model:
    weights: np.ndarray
    #: kind -> labeller -> estimated chance that its vote is right (None: it never votes).
    reliabilities: dict[str, dict[str, float | None]]


def train(found: DataFrame, fit: Fit = Fit()) -> Model:
    """The span classifier, from a table with the column ``spans``."""
    each = found.select(F.explode("spans").alias("s")).select("s.*")
    counts = {(r["kind"], r["votes"]): r["n"] for r in each.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model(np.zeros(WIDTH), {})
    keys = sorted(counts)
    kinds, codes = (np.array(v, dtype=np.int64) for v in zip(*keys))
    post, chances, shares = estimate_by_kind(decode(codes, len(LABELLERS)), np.array([counts[k] for k in keys], dtype=float), kinds, fit.prior)
    target = dict(zip(keys, post))
    sure = {KINDS[k]: dict(zip(LABELLERS, reliability(chances[k], shares[k]))) for k in chances}
    # A hundred spans of each kind and pattern at least, so that rare ones teach the classifier too.
    total = sum(counts.values())
    part = F.create_map(*[x for k, n in counts.items() for x in (F.lit(f"{k[0]}:{k[1]}"), F.lit(int(min(1.0, max(fit.sample_spans / total, 100 / n)) * 1_000_000)))])
    chance = F.pmod(F.xxhash64("start", "end", "votes", F.col("shape")[2]), F.lit(1_000_000))
    some = each.where(chance < F.element_at(part, F.concat_ws(":", "kind", "votes"))).groupBy("kind", "votes", "shape").agg(F.count("*").alias("n"))
    pdf = some.toPandas()
    pdf["order"] = pdf["shape"].map(tuple)
    pdf = pdf.sort_values(["kind", "votes", "order"])
    x = _inputs(pdf["kind"].to_numpy(), pdf["votes"].to_numpy(), np.array(pdf["shape"].tolist(), dtype=float).reshape(len(pdf), 4))
    y, n = np.array([target[k] for k in zip(pdf["kind"], pdf["votes"])]), np.sqrt(pdf["n"].to_numpy(float))
    w, squares = np.zeros(WIDTH), np.full(WIDTH, 1e-3)
    for _ in range(fit.passes):
        q = 1 / (1 + np.exp(-np.clip((x * w).sum(axis=1), -30, 30)))
        g = (((q - y) * n)[:, None] * x).sum(axis=0) / max(n.sum(), 1) + 1e-4 * w
        squares += g * g
        w -= 0.5 * g / np.sqrt(squares)
    return Model(w, sure)


def accept(w: np.ndarray, threshold: float):
    """Spans that stay: all base ones, and candidates the classifier accepts."""

    def keep(rows) -> list:
        if not len(rows):
            return []
        kind = np.array([r["kind"] for r in rows])
        if kind.max() < len(BASE):
            return list(rows)
        x = _inputs(kind, np.array([r["votes"] for r in rows]), np.array([r["shape"] for r in rows], dtype=float))
        p = 1 / (1 + np.exp(-np.clip((x * w).sum(axis=1), -30, 30)))
        return [r for r, k, q in zip(rows, kind, p) if k < len(BASE) or q >= threshold]

    return keep


def _spans_of():
    @pandas_udf(f"array<{SPAN}>")
    def spans_of(texts: pd.Series) -> pd.Series:
        return pd.Series([judged_spans(t or "") for t in texts], dtype=object)

    return spans_of


def judged(docs: DataFrame) -> DataFrame:
    """doc_id and all judged spans, base ones and candidates, of every row."""
    return materialize(id_text(docs).select("doc_id", _spans_of()("text").alias("spans")), "pii-spans")


def find(docs: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """One row per input row: base counts, digest of base spans, number of spans, and all as text."""
    found = judged(docs)
    keep = accept(train(found, fit).weights, fit.threshold)

    @pandas_udf("struct<n_email: long, n_ip: long, n_card: long, n_phone: long, base: string, spans: string, n_spans: long>")
    def digest(spans: pd.Series) -> pd.DataFrame:
        out = []
        for rows in spans:
            kept = keep(rows)
            named = [f"{KINDS[r['kind']]}:{r['start']}:{r['end']}" for r in kept]
            base = [n for n, r in zip(named, kept) if r["kind"] < len(BASE)]
            kinds = [r["kind"] for r in kept]
            out.append((*[kinds.count(k) for k in range(len(BASE))], ",".join(base), ",".join(named), len(kept)))
        return pd.DataFrame(out, columns=["n_email", "n_ip", "n_card", "n_phone", "base", "spans", "n_spans"])

    read = found.select("doc_id", digest("spans").alias("d"))
    return read.select("doc_id", "d.n_email", "d.n_ip", "d.n_card", "d.n_phone", F.sha2("d.base", 256).alias("base_sha256"), "d.spans", "d.n_spans")


def redact(docs: DataFrame, fit: Fit = Fit(), text_col: str = "text") -> DataFrame:
    """The input with every found span replaced by its kind in brackets; no join, no shuffle.

    Rows are written with their spans, so texts are searched once and an executor lost later
    costs a re-read.
    """
    names = docs.columns
    row = F.struct(*[same(c).alias(c) for c in names]).alias("row")
    found = materialize(docs.select(row, same(text_col).alias("text")).select("row", _spans_of()("text").alias("spans")), "pii-rows")
    keep = accept(train(found, fit).weights, fit.threshold)

    @pandas_udf("string")
    def cleaned(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, rows in zip(texts, spans):
            if t is None or not len(rows):
                out.append(t)
                continue
            parts, at = [], 0
            for r in sorted(keep(rows), key=lambda r: (r["start"], -r["end"])):
                if r["end"] <= at:
                    continue
                if r["start"] >= at:
                    parts += [t[at : r["start"]], f"[{KINDS[r['kind']]}]"]
                at = r["end"]
            out.append("".join(parts) + t[at:])
        return pd.Series(out, dtype=object)

    new = found.select("row", cleaned(F.col("row")[text_col], F.col("spans")).alias("new"))
    cols = {text_col: F.col("new")}
    if "n_chars" in names:
        cols["n_chars"] = F.length("new").cast(docs.schema["n_chars"].dataType)
    return new.select(*[cols.get(c, F.col("row")[c]).alias(c) for c in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir))
