"""Operator 8: personal data by weak supervision."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.spans import Cover, count, digest, joined
from kerbside.plans.scratch import Scratch

#: The first four are found by their patterns alone; spans of the others are added where the classifier is sure.
KINDS = ("email", "ip", "card", "phone", "address", "ssn", "iban", "name", "national")
#: Labelers, in the order of their votes.
LABELERS = ("form", "gazetteer", "before", "after", "edge", "placeholder")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AT, _DOT = r"(?:\x20?[\[({]\x20?at\x20?[\])}]\x20?|\x20at\x20|@)", r"(?:\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\x20dot\x20)"
ADDRESS = re.compile(rf"\b[A-Za-z0-9._%+-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}(?:\.[A-Za-z0-9-]{{1,63}}){{0,3}}(?:{_DOT}[A-Za-z]{{2,24}}){{1,3}}\b|\b[A-Za-z0-9._%+-]{{1,64}}\x20?[\[({{]\x20?at\x20?[\])}}]\x20?[A-Za-z0-9-]{{1,63}}(?:\.[A-Za-z0-9-]{{2,24}}){{1,3}}\b", re.I | re.A)
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", re.A)
NAME = re.compile(r"\b[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]{1,20}(?:\x20[A-ZÀ-ÖØ-Þ]\.)?(?:\x20[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]{1,20}){1,2}\b")
NATIONAL = re.compile(r"(?<![0-9+.-])(?:\([0-9]{2,5}\)\x20?|0[0-9]{2,4}[\x20/-]|[0-9]{3}[-.\x20])[0-9]{3,4}(?:[-.\x20][0-9]{2,4}){1,2}(?![0-9.-])")
# Words that stand near personal data or against it, titles and given names, country codes, endings of
# hosts and calling codes of the gazetteers.
CONTEXT = (
    re.compile(r"e-?mail|contact|write\x20to|mailto|reach", re.I),
    re.compile(r"\bip\b|address|host|server|login", re.I),
    re.compile(r"card|visa|credit|payment|account", re.I),
    re.compile(r"phone|tel\b|call|mobile|fax|contact", re.I),
    re.compile(r"e-?mail|contact|write\x20to|reach", re.I),
    re.compile(r"ssn|social\x20security", re.I),
    re.compile(r"iban|bank|account|transfer", re.I),
    re.compile(r"\b(?:mr|mrs|ms|dr|prof|herr|frau|monsieur|madame|señor|señora|name|contact|signed|dear|regards|patient|by)\b", re.I),
    re.compile(r"phone|tel\b|call|mobile|fax|contact", re.I),
)
AGAINST = re.compile(r"version|release|build|serial|isbn|part\x20no|figure|table|example\b|sample|order", re.I)
GIVEN = frozenset(
    "adam alan alice amanda amy andrea andrew angela anna anne anthony antonio barbara benjamin brian carlos carmen carol caroline catherine charles charlotte christian christina christine christopher claire claudia "
    "daniel david deborah dennis diana diego donald dorothy edward elena elizabeth emily emma eric eva fernando francisco frank gabriel george gloria hannah hans heather helen helena henry isabel jack jacob james jan jane "
    "janet jason jean jennifer jessica joan john jonas jonathan jorge jose joseph juan julia julie karen karl katharina kevin klaus laura lena linda lisa louis lucas luis lukas manuel marco margaret maria marie mark markus "
    "martha martin mary matthew max melissa michael michelle miguel monica nancy nathalie nicholas nicole olivia oscar pablo patricia patrick paul pedro peter philip pierre rachel ralf raul rebecca richard robert rosa ruth "
    "samuel sandra sarah sebastian sofia sophie stefan stephanie stephen steven susan sylvia teresa thomas timothy ursula veronica victor victoria walter william".split()
)
COUNTRIES = frozenset("AD AE AL AT BA BE BG CH CY CZ DE DK EE ES FI FR GB GI GR HR HU IE IL IS IT KW LB LI LT LU LV MC MD ME MK MT NL NO PL PT QA RO RS SA SE SI SK SM TN TR UA".split())
DOMAINS = frozenset("at au be biz br ca ch cn co com cz de dk edu es eu fi fr gov ie in info int io it jp me mil mx net nl no nz org pl pt ru se uk us za".split())
CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 351 352 353 354 355 356 357 358 359 370 371 372 380 381 385 386 420 421".split())
#: A span is added from this probability on.
SURE = 0.9
_FEATURES = 48
_PATTERNS = 3 ** len(LABELERS)


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if k % 2:
            x = 2 * x - 9 if x > 4 else 2 * x
        total += x
    return total % 10 == 0


def _mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str):
    """Leftmost matches without overlap of LOCAL+ @ DOMAIN, in linear time: the local part is the run before an @."""
    done, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            yield a, m.end()
            done = m.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    out = [(0, a, b) for a, b in emails(text)]
    if any(c in text for c in "0123456789"):
        out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, *m.span()))
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def more_spans(text: str):
    """Candidates of the other kinds; wide, as it is for labelers and classifier to decide."""
    low = text.lower()
    if "dot" in low or "[at" in low or "(at" in low or "{at" in low or "( at" in low or "[ at" in low:
        yield from ((4, *m.span()) for m in ADDRESS.finditer(text))
    if "-" in text:
        yield from ((5, *m.span()) for m in SSN.finditer(text))
    if any(c in text for c in "0123456789"):
        yield from ((6, *m.span()) for m in IBAN.finditer(text) if 15 <= len(m.group().replace(" ", "")) <= 34)
        yield from ((8, *m.span()) for m in NATIONAL.finditer(text) if not SSN.fullmatch(m.group()))
    yield from ((7, *m.span()) for m in NAME.finditer(text))


def _sign(yes: bool, no: bool = False) -> int:
    return 1 if yes else -1 if no else 0


def votes(text: str, words: frozenset[str], kind: int, a: int, b: int) -> tuple[int, ...]:
    """Votes of LABELERS: 1 for personal data, -1 against, 0 for neither. words: the words of the text without capitals.

    form: check digits and rules of the kind. gazetteer: given names, hosts' endings, countries, calling codes, reserved
    addresses. before, after: words near by. edge: letters or digits that go on. placeholder: digits in a row or all
    alike, hosts of examples, and names that repeat a word or whose words the text also has without capitals.
    """
    s = text[a:b]
    digits = "".join(c for c in s if c.isdigit())
    form = listed = 0
    placeholder = len(digits) > 6 and (len(set(digits[-6:])) == 1 or digits[-6:] in "0123456789012345")
    if kind in (0, 4):
        end = re.split(r"[^A-Za-z0-9]+", s.rstrip("])}"))[-1].lower()
        form, listed = _sign(end.isalpha() and 2 <= len(end) <= 6, not end.isalpha()), _sign(end in DOMAINS)
        placeholder = "example" in s.lower()
    elif kind == 1:
        parts = s.split(".")
        form = _sign(all(p == "0" or not p.startswith("0") for p in parts), True)
        listed = _sign(parts[0] not in ("0", "127", "255"), True)
    elif kind == 2:
        form, listed = _sign(len(digits) == 16), _sign(digits[0] in "3456", digits[0] in "0789")
    elif kind == 3:
        form, listed = _sign(9 <= len(digits) <= 13), _sign(any(digits[:k] in CALLING for k in (1, 2, 3)), digits[0] == "0")
    elif kind == 5:
        form = _sign(not (s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[7:] == "0000"), True)
    elif kind == 6:
        form, listed = _sign(_mod97(s), True), _sign(s[:2] in COUNTRIES, True)
    elif kind == 7:
        names = s.lower().split(" ")
        listed = _sign(names[0] in GIVEN)
        form = -1 if a == 0 or text[max(0, a - 2) : a].rstrip(" ")[-1:] in (".", "!", "?", "\n", ":") else 0
        placeholder = len(set(names)) < len(names) or any(n in words for n in names)
    else:
        form = _sign(9 <= len(digits) <= 11, True)
        listed = _sign("(" in s or s[0] == "0")
    before, after = text[max(0, a - 40) : a], text[b : b + 30]
    near = [_sign(bool(CONTEXT[kind].search(t)), bool(AGAINST.search(t))) for t in (before, after)]
    edge = _sign(False, text[b : b + 1].isalnum() or text[a - 1 : a].isalnum())
    return form, listed, *near, edge, _sign(False, placeholder)


def features(text: str, a: int, b: int) -> int:
    """What the span classifier sees beside kind and votes: length, share of digits, inner spaces, start of a line."""
    s = text[a:b]
    share = sum(c.isdigit() for c in s) / len(s)
    return ((min(3, len(s) // 10) * 3 + int(share * 2.999)) * 2 + (" " in s)) * 2 + (a == 0 or text[a - 1] == "\n")


def code(kind: int, v: tuple[int, ...], feature: int) -> int:
    """Kind, votes and features in one number."""
    k = kind
    for x in v:
        k = k * 3 + x + 1
    return k * _FEATURES + feature


def decoded(codes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds, votes (0 against, 1 neither, 2 for) and features of codes."""
    c = np.array(codes, np.int64)
    v = c // _FEATURES % _PATTERNS
    votes = np.stack([v // 3**j % 3 for j in range(len(LABELERS) - 1, -1, -1)], 1)
    return c // (_FEATURES * _PATTERNS), votes, c % _FEATURES


def expectation_maximization(kind: np.ndarray, v: np.ndarray, n: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, dict]:
    """Probability that a pattern of votes is personal data, and by kind its share and the reliabilities of labelers.

    Per kind, a span is personal data or not, and each labeler then votes by a distribution of its own (Dawid and Skene
    1979), estimated from the counts n of patterns alone. The two classes can't change places: the start trusts what
    form or gazetteer accept, an abstention says nothing, a vote for never lowers a probability and a vote against never
    raises it, and what no labeler votes for isn't personal data. Returns also kind -> (share, for each labeler
    its votes' distribution over personal data, and over the rest).
    """
    backed, anchored = (v == 2).any(1), (v[:, :2] == 2).any(1)
    q = 1 / (1 + np.exp(-(1.5 * (v - 1).sum(1) - np.where(anchored, 0.0, 2.0))))
    for _ in range(rounds):
        new, found = q.copy(), {}
        for k in np.unique(kind):
            at = kind == k
            w1, w0 = n[at] * q[at], n[at] * (1 - q[at])
            share = (w1.sum() + 1) / (w1.sum() + w0.sum() + 2)
            log = np.full(at.sum(), np.log(share / (1 - share)))
            t1 = [np.array([0.5, 1.0, 1.0]) + np.bincount(v[at, j], w1, 3) for j in range(v.shape[1])]  # a right vote is likelier
            t0 = [np.array([1.0, 1.0, 0.5]) + np.bincount(v[at, j], w0, 3) for j in range(v.shape[1])]
            t1, t0 = [t / t.sum() for t in t1], [t / t.sum() for t in t0]
            for j in range(v.shape[1]):
                says = np.log(t1[j]) - np.log(t0[j])
                log = log + np.array([min(says[0], 0.0), 0.0, max(says[2], 0.0)])[v[at, j]]
            new[at] = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
            new[at] = np.where(backed[at], new[at], 0.0)
            found[int(k)] = (float(share), t1, t0)
        change, q = np.abs(new - q).max(), new
        if change < 1e-9:
            break
    return q, found


def fit_labelers(codes: list[int], counts: list[int]) -> dict[int, float]:
    """Code -> probability: expectation_maximization over vote patterns, then a logistic span classifier on its labels.

    The classifier sees kind, votes and features of the span, and is fitted to the probabilities by Newton steps with a
    ridge: so what spans look like counts where labelers are of two minds.
    """
    if not codes:
        return {}
    n = np.array(counts, float)
    kind, v, feature = decoded(codes)
    pattern = kind * _PATTERNS + v @ (3 ** np.arange(v.shape[1]))
    _, first, inverse = np.unique(pattern, return_index=True, return_inverse=True)
    q, _ = expectation_maximization(kind[first], v[first], np.bincount(inverse, n))
    q = q[inverse]
    shape = [feature // 12, feature // 4 % 3, feature // 2 % 2, feature % 2]
    x = np.concatenate([np.eye(len(KINDS))[kind], *(np.eye(3)[v[:, j]] for j in range(v.shape[1])), *(np.eye(m)[f] for f, m in zip(shape, (4, 3, 2, 2)))], 1)
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        weight = n * np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * weight[:, None]).T @ x + 0.1 * np.eye(len(beta)), x.T @ (n * (q - p)) - 0.1 * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
    return dict(zip((int(k) for k in codes), (float(y) for y in p)))


def personal_spans(docs: DataFrame, sure: float = SURE) -> DataFrame:
    """Personal data of each document.

    docs: columns doc_id, text; others are ignored. Returns, for each row, doc_id, base, spans and doubted: the first
    two arrays of (kind, start, end), kind a place in KINDS, in code points, end exclusive. base has the matches of the
    first four kinds, per kind leftmost and without overlap; spans has these and, outside of them, those of the other
    kinds that form or gazetteer vote for and the span classifier finds at least this sure; doubted counts the base
    spans that it finds less likely than not.

    Tasks write spans with their votes and features; these are counted over all documents, equal strings of a document
    once, and labelers and classifier fitted to the counts (fit_labelers). There are at most len(KINDS) * 3 **
    len(LABELERS) * 48 of them, which tasks get as arrays.

    Null text: empty. Rows that repeat count each. Empty input: no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)

    def run(batches):
        for b in batches:
            base, more, codes = [], [], []
            for text in b.column(1).to_pylist():
                text = text or ""
                found = base_spans(text)
                cover = Cover(found)
                other = [s for s in more_spans(text) if not cover.touches(s[1], s[2])]
                words = frozenset(w for w in re.findall(r"\w+", text) if w[0].islower()) if any(k == 7 for k, _, _ in other) else frozenset()
                coded = lambda s: {"code": code(s[0], votes(text, words, *s), features(text, s[1], s[2])), "kind": s[0], "start": s[1], "end": s[2]}  # noqa: E731, B023
                base.append([coded(s) for s in found])
                more.append([coded(s) for s in other])
                codes.append(list({(m["kind"], text[m["start"] : m["end"]]): m["code"] for m in base[-1] + more[-1]}.values()))
            kinds = pa.list_(pa.struct([("code", pa.int32()), ("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.record_batch([b.column(0), pa.array(base, kinds), pa.array(more, kinds), pa.array(codes, pa.list_(pa.int32()))], names=["doc_id", "base", "more", "codes"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    coded = "array<struct<code:int,kind:int,start:long,end:long>>"
    d = scratch.write(d.mapInArrow(run, f"doc_id long, base {coded}, more {coded}, codes array<int>"), "personal")
    codes = d.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n")).orderBy("code").collect()
    p = fit_labelers([r.code for r in codes], [r.n for r in codes])
    accepted = (decoded(list(p))[1][:, :2] == 2).any(1) if p else []
    good = np.array(sorted(k for (k, x), yes in zip(p.items(), accepted) if x >= sure and yes), np.int32)
    bad = np.array(sorted(k for k, x in p.items() if x < 0.5), np.int32)
    # A string that stands twice in a document under different votes may have a code that wasn't counted: it is no one's.

    def decide(batches):
        for b in batches:
            more = b.column(2)
            of = np.repeat(np.arange(b.num_rows), more.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            keep = np.isin(more.flatten().field("code").to_numpy(zero_copy_only=False), good)
            base = b.column(1)
            owner = np.repeat(np.arange(b.num_rows), base.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            doubt = np.bincount(owner[np.isin(base.flatten().field("code").to_numpy(zero_copy_only=False), bad)], minlength=b.num_rows)
            chosen = more.flatten().filter(pa.array(keep))
            offsets = np.append(0, np.cumsum(np.bincount(of[keep], minlength=b.num_rows))).astype(np.int32)
            yield pa.record_batch([b.column(0), base, pa.ListArray.from_arrays(pa.array(offsets), chosen), pa.array(doubt.astype(np.int64))], names=["doc_id", "base", "added", "doubted"])

    plain = lambda c: F.transform(c, lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    d = d.select("doc_id", "base", "more").mapInArrow(decide, f"doc_id long, base {coded}, added {coded}, doubted long")
    return d.select("doc_id", plain("base").alias("base"), F.concat(plain("base"), plain("added")).alias("spans"), "doubted")


def personal_report(docs: DataFrame) -> DataFrame:
    """personal_spans as counts, digest and list; n_spans: all spans, n_doubted: base spans that the classifier doubts."""
    d = personal_spans(docs)
    return d.select("doc_id", *(count(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(4)), digest(F.col("base"), KINDS, True).alias("base_sha256"), joined(F.col("spans"), KINDS, True).alias("spans"), F.size("spans").cast("long").alias("n_spans"), F.col("doubted").alias("n_doubted"))
