"""Personal data by boosted trees over generated candidates.

Base rules find emails, IPv4 addresses, card numbers and phone numbers; what they find always stays. Further generators
of high recall propose spans that may overlap those and each other: emails and IPv4 addresses with spelled-out or bracketed
dots and ats, digit groups that could be phone or card numbers, cards side by side. Gradient-boosted trees score each candidate from its
format and its context; scores are calibrated for each kind, and a kind's threshold is the least one, from 0.5
up, at which the calibration fold's precision reaches ``PRECISION``. Accepted candidates that overlap no base span, and no better candidate, of any kind are added.

The trees are trained here on ``EXAMPLES`` generated examples (a documented bound; fixed seed): formats of personal
data and look-alikes such as dates, versions, prices and order numbers, in neutral or telling contexts.

Defined results: null and empty texts have no span. Offsets are code points, ends exclusive. Repeated rows give
repeated results. Texts are read whole; the rules take linear time on long runs of digits or letters. Extra columns are
ignored.
"""

from __future__ import annotations

import random
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import map_texts, table

KINDS = ("email", "ip", "card", "phone")
EXAMPLES, PRECISION, SEED, CONTEXT = 8000, 0.98, 3, 24

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only begin where a run of digits begins: what could begin within a run could also begin before it.
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of local part, @ and a dotted domain, found from each @."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at)
        at = text.find("@", max(at + 1, free))
    return out


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """What the rules find, by kind."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    out["email"] = emails(text)
    out["ip"] = [m.span() for m in _IP.finditer(text) if all(map(_octet, m.groups()))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


#: Blanks are bounded, so that long runs of them take linear time.
_AT = re.compile(r"[aA][tT](?=[\s)\]}])|@")
_BRACKETS = {"(": ")", "[": "]", "{": "}"}
_SPELLED = r"\s{1,3}dot\s{1,3}|\s?\(dot\)\s?|\s?\[dot\]\s?|\s?\{dot\}\s?|\s?\[\.\]\s?|\s?\(\.\)\s?"
_HOST = re.compile(rf"[A-Za-z0-9-]+(?:(?:\.|{_SPELLED})[A-Za-z0-9-]+)+", re.I)
_DOT = re.compile(_SPELLED, re.I)
_QUAD = re.compile(rf"(?<![0-9.])([0-9]{{1,3}})(?:{_SPELLED}|\s?\.\s?)([0-9]{{1,3}})(?:{_SPELLED}|\s?\.\s?)([0-9]{{1,3}})(?:{_SPELLED}|\s?\.\s?)([0-9]{{1,3}})(?![0-9])", re.I)
_GROUPS = re.compile(r"(?<![0-9A-Za-z])\(?[0-9]{1,6}(?:[\x20().-]{1,2}[0-9]{2,6}){1,6}(?![0-9A-Za-z])")
_LONG = re.compile(r"(?<![0-9A-Za-z])[0-9]{8,19}(?![0-9A-Za-z])")
_DIGITS = re.compile(r"[0-9]+")


def _blanks(text: str) -> str:
    return text[: len(text) - len(text.lstrip())]


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans that may be personal data besides those of the rules; they may overlap."""
    out = []
    for m in _AT.finditer(text):
        begin, end = m.span()
        if m[0] != "@":  # a word of its own, or in brackets
            before, most = text[begin - 1 : begin], 3
            if before in _BRACKETS and text[end] == _BRACKETS[before]:
                begin, end, most = begin - 1, end + 1, 1
            elif not (before.isspace() and text[end].isspace()):
                continue
            begin = begin - len(_blanks(text[max(0, begin - most) : begin][::-1]))
            end = end + len(_blanks(text[end : end + most]))
        start = begin
        while start and _LOCAL.match(text, start - 1):
            start -= 1
        host = _HOST.match(text, end) if start < begin else None
        if host and (m[0] != "@" or _DOT.search(host[0])):
            out.append(("email", start, host.end()))
    for m in _QUAD.finditer(text):
        if not _IP.fullmatch(m[0]) and all(map(_octet, m.groups())):
            out.append(("ip", *m.span()))
    for pattern in (_GROUPS, _LONG):
        for m in pattern.finditer(text):
            n = sum(c.isdigit() for c in m[0])
            if 7 <= n <= 15:
                out.append(("phone", *m.span()))
            if 13 <= n <= 19:
                out.append(("card", *m.span()))
    for m in _CARD.finditer(text):  # cards side by side: runs of whole groups that pass
        groups = [g.span() for g in _DIGITS.finditer(text, m.start(), m.end())] if m.end() - m.start() > 19 else []
        for i, (begin, _) in enumerate(groups):
            n = 0
            for a, z in groups[i : i + 19]:
                n += z - a
                if n > 19:
                    break
                if 13 <= n and luhn(_NOT_DIGIT.sub("", text[begin:z])):
                    out.append(("card", begin, z))
    return list(dict.fromkeys(out))


_CUES = {
    "email": ("mail", "contact", "write", "reach"), "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment", "carte", "karte", "tarjeta"), "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "anruf", "llam"),
}
_AGAINST = ("order", "version", "isbn", "invoice", "serial", "ticket", "ref", "part", "price", "total", "build", "date", "id", "no.", "#")


def describe(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context features of a span."""
    span, before, after = text[start:end], text[max(0, start - CONTEXT) : start].lower(), text[end : end + 8].lower()
    digits = _NOT_DIGIT.sub("", span)
    groups = [g for g in _NOT_DIGIT.split(span) if g]
    sizes = [len(g) for g in groups] + [0, 0, 0, 0]
    return [
        KINDS.index(kind), len(span), len(digits), len(groups), *sizes[:4], max(sizes),
        sum(c.isalpha() for c in span), span.count("-"), span.count(" "), span.count("."), span.count("("), float(span[:1] == "("),
        float(luhn(digits)) if digits else 0.0, float(digits[:1] or -1), len(set(digits)),
        float("at" in span.lower()), float("dot" in span.lower()), len(re.split(r"[^A-Za-z]+", span)[-1]),
        max((float(c in before) for c in _CUES[kind]), default=0.0), sum(c in before for k in KINDS for c in _CUES[k] if k != kind), sum(c in before for c in _AGAINST),
        float(before[-1:].isspace() or not before), float(before[-1:] in "$€£#=/:"), float(before[-1:] == "+"), float(after[:1] in "%€$/"), float(after[:1].isspace() or not after),
        float(bool(re.match(r"(19|20)[0-9]{2}\b", span))), float(bool(re.search(r"[0-9]{3}[\x20.)-]{1,2}[0-9]{3}[\x20.-][0-9]{4}\Z", span))),
    ]


# --- boosted trees -------------------------------------------------------------------------------


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 24) -> dict:
    """Second-order gradient boosting of the log loss on quantile bins."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    f, grown = np.full(len(y), start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        node, tree = np.zeros(len(y), int), {}
        for level in range(depth):
            for k in range(1 << level):
                own = node == k + (1 << level) - 1
                if own.sum() < 40:
                    continue
                best = (1e-3, -1, -1)
                G, H = g[own].sum(), h[own].sum()
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gs, hs = np.cumsum(np.bincount(binned[own, j], g[own], len(c) + 1))[:-1], np.cumsum(np.bincount(binned[own, j], h[own], len(c) + 1))[:-1]
                    gain = gs**2 / (hs + 1) + (G - gs) ** 2 / (H - hs + 1) - G**2 / (H + 1)
                    i = int(gain.argmax())
                    best = max(best, (float(gain[i]), j, i))
                if best[1] >= 0:
                    at = k + (1 << level) - 1
                    tree[at] = (best[1], float(cuts[best[1]][best[2]]))
                    right = x[:, best[1]] > tree[at][1]
                    node = np.where(own, 2 * at + 1 + right, node)
        values = {int(n): rate * g[node == n].sum() / (h[node == n].sum() + 1) for n in np.unique(node)}
        f = f + np.array([values[n] for n in node.tolist()])
        grown.append((tree, values))
    return {"start": start, "trees": grown}


def margin(model: dict, x: np.ndarray) -> np.ndarray:
    f = np.full(len(x), model["start"])
    for tree, values in model["trees"]:
        node = np.zeros(len(x), int)
        while True:
            moved = False
            for at, (j, cut) in tree.items():
                own = node == at
                if own.any():
                    node[own], moved = 2 * at + 1 + (x[own, j] > cut), True
            if not moved:
                break
        f += np.array([values.get(n, 0.0) for n in node.tolist()])
    return f


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _card(r: random.Random, good: bool) -> str:
    d = r.choice("3456") + _digits(r, r.choice([12, 13, 14, 14, 14]))
    d += next(c for c in "0123456789" if luhn(d + c) == good)
    return r.choice(["", "", " ", "-"]).join(d[i : i + 4] for i in range(0, len(d), 4))


def examples(n: int = EXAMPLES, seed: int = SEED) -> list[tuple[str, str, int, int, int]]:
    """(text, kind, start, end, label): generated personal data and look-alikes."""
    r, out = random.Random(seed), []
    word = lambda: "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(2, 9)))
    sep = lambda: r.choice(["-", " ", "."])
    while len(out) < n:
        kind, good, s = r.choice(["email", "ip", "card", "phone", "phone"]), r.random() < 0.5, ""
        cue = ""
        if kind == "email":
            if good:
                at, dot = r.choice([(" at ", " dot "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("@", " dot "), ("{at}", "{dot}"), ("@", "[.]"), (" at ", ".")])
                s = word() + r.choice(["", "." + word(), _digits(r, 2)]) + at + "".join(word() + dot for _ in range(r.choice([1, 1, 2]))) + r.choice(["com", "org", "net", "de", "fr", "io", "edu", "uk"])
                cue = r.choice(["", "", "mail ", "write to ", "contact: "])
            else:
                s = r.choice([f"{word()} at {word()} dot {word()}{word()}", f"{word()} at {word()}.{word().capitalize()}{word()}", f"{word()} at {_digits(r, 1)}.{_digits(r, 2)}"])
        elif kind == "ip":
            dot = r.choice(["[.]", " dot ", "(.)", " . ", "(dot)", "[dot]"]) if good else r.choice([". ", " .", ". ", " . "])
            s = dot.join(str(r.randint(0, 255) if good else r.randint(0, 30)) for _ in range(4))
            cue = r.choice(["host ", "server ", "ip ", "address ", "from ", ""]) if good else r.choice(["steps ", "version ", "rows ", "parts ", "items ", "in "])
        elif kind == "card":
            s = _card(r, good)
            cue = r.choice(["card ", "pay with visa ", "credit card no ", "", ""]) if good else r.choice(["order ", "serial ", "", "", "ref "])
            if not good and r.random() < 0.5:
                s = _digits(r, r.choice([13, 14, 15, 16, 17, 18]))
                good = False
        elif good:
            a = sep()
            s = r.choice([f"({_digits(r, 3)}) {_digits(r, 3)}-{_digits(r, 4)}", f"{_digits(r, 3)}{a}{_digits(r, 3)}{a}{_digits(r, 4)}", f"0{_digits(r, 1)} {_digits(r, 2)} {_digits(r, 2)} {_digits(r, 2)} {_digits(r, 2)}", f"0{_digits(r, 3)} {_digits(r, 6)}"])
            cue = r.choice(["call ", "phone: ", "tel. ", "mobile ", "fax ", "call me on "])
        else:
            s = r.choice([
                f"20{_digits(r, 2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", f"{r.randint(1, 9)}.{_digits(r, 2)}.{_digits(r, 4)}", _digits(r, r.randint(8, 15)), f"{_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 5)}",
                f"{_digits(r, 3)} {_digits(r, 3)} {_digits(r, 3)}", f"978-{_digits(r, 1)}-{_digits(r, 4)}-{_digits(r, 3)}", f"{_digits(r, 4)}-{_digits(r, 4)}", f"{_digits(r, 3)}-{_digits(r, 3)}-{_digits(r, 4)}",
            ])
            cue = r.choice(["order ", "version ", "total ", "isbn ", "invoice #", "", "", "", "on ", "ticket "])
        head = " ".join(word() for _ in range(r.randint(1, 5))) + " " + cue
        text = head + s + r.choice([" ", ". ", ", "]) + word()
        for k, a, z in candidates(text):
            if k == kind and a < len(head) + len(s) and z > len(head):
                out.append((text, k, a, z, int(good)))
    return out[:n]


@cache
def model() -> bytes:
    """Trees, calibration and thresholds, as bytes."""
    rows = examples()
    x = np.array([describe(t, k, a, z) for t, k, a, z, _ in rows], float)
    y = np.array([r[4] for r in rows], float)
    fold = np.arange(len(rows)) % 4 == 3
    trees = boost(x[~fold], y[~fold])
    held = margin(trees, x[fold])
    calibrated = {}
    for i, kind in enumerate(KINDS):
        own = x[fold][:, 0] == i
        z, t = held[own], y[fold][own]
        if not len(z) or not t.any():
            calibrated[kind] = (1.0, 0.0, 2.0)
            continue
        a, b = 1.0, 0.0
        for _ in range(200):  # logistic calibration of the margin
            p = 1 / (1 + np.exp(-(a * z + b)))
            a, b = a - 0.5 * float(((p - t) * z).mean()) / max(1.0, float((z * z).mean())), b - 0.5 * float((p - t).mean())
        p = 1 / (1 + np.exp(-(a * z + b)))
        order = np.argsort(-p)
        precision = np.cumsum(t[order]) / np.arange(1, len(t) + 1)
        fine = np.flatnonzero(precision >= PRECISION)
        calibrated[kind] = (a, b, max(0.5, float(p[order][fine[-1]])) if len(fine) else 2.0)
    return cloudpickle.dumps({"trees": trees, "calibrated": calibrated})


def find(text: str, m: dict) -> tuple[dict[str, list], list[tuple[str, int, int]]]:
    """(base spans by kind, added spans)."""
    base, added = base_spans(text), []
    proposed = candidates(text)
    if proposed:
        z = margin(m["trees"], np.array([describe(text, *c) for c in proposed], float))
        scored = []
        for (kind, a, e), s in zip(proposed, z):
            slope, shift, least = m["calibrated"][kind]
            p = 1 / (1 + np.exp(-(slope * s + shift)))
            if p >= least:
                scored.append((-p, a, e, kind))
        taken = [(a, e) for spans in base.values() for a, e in spans]
        for _, a, e, kind in sorted(scored):
            if all(e <= b or a >= f for b, f in taken):
                taken.append((a, e))
                added.append((kind, a, e))
    return base, added


def detect(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns, ``base`` and ``added``: the spans (kind, start, end) that the rules find and that the trees add."""
    shared = docs.sparkSession.sparkContext.broadcast(model())
    span = "array<struct<kind:string,start:long,end:long>>"

    def kernel():
        m = cloudpickle.loads(shared.value)

        def judge(raw: list[bytes], _: pa.RecordBatch) -> dict:
            out = {"base": [], "added": []}
            for text in raw:
                base, added = find(text.decode("utf-8", "replace"), m)
                out["base"].append([{"kind": k, "start": a, "end": z} for k in KINDS for a, z in base[k]])
                out["added"].append([{"kind": k, "start": a, "end": z} for k, a, z in added])
            return out

        return judge

    return map_texts(docs, keep, f"base {span}, added {span}", kernel)


def _joined(spans: F.Column) -> F.Column:
    at = F.transform(spans, lambda s: F.struct(F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("o"), s["start"].alias("a"), s["end"].alias("z"), s["kind"].alias("k")))
    return F.array_join(F.transform(F.array_sort(at), lambda s: F.concat_ws(":", s["k"], s["a"].cast("string"), s["z"].cast("string"))), ",")


def _count(kind: str) -> F.Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digest of the base spans, and all spans."""
    found = detect(table(spark, sf_dir, "documents"), ["doc_id"])
    counts = [_count(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))
