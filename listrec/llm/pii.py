"""Personal data: high-recall candidates, boosted trees, calibrated thresholds.

Exact base patterns find emails, addresses, cards and phones and always stay.
Wider generators propose more spans, which may overlap; boosted trees score each
from its format and context, and a threshold calibrated for precision on held-out
candidates decides which are added.  The trees learn from emails, phones and cards
(those that the base patterns find, and invented ones) written in other forms, and
from dates, ranges, versions, prices and prose that look like them.  The forms and the
lookalikes on which thresholds are set and figures reported are others than those
learned from.  Account codes are told by their length and checksum alone.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, span_key

KINDS = ("email", "ip", "card", "phone", "more_email", "more_number", "more_code")
N_BASE = 4

# The base patterns.  Possessive runs and the look-behind only stop
# needless retries inside a run of the same class.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# Generators of further candidates: the sign of an email, from which its local part is
# sought backwards and its domain forwards; digits in groups; account codes.
SIGN = re.compile(r"@|(?<=[\x20(\[{<])[aA][tT](?=[\x20)\]}>])")
BEFORE = re.compile(r"\x20{0,2}[\[({<]?\x20?$")
DOT_BEFORE = re.compile(r"(?:\x20{0,2}[\[({<]\x20?[dD][oO][tT]\x20?[\])}>]\x20{0,2}|\x20{1,2}[dD][oO][tT]\x20{1,2})$")
AFTER = re.compile(r"\x20?[\])}>]?\x20{0,2}")
DOT = r"(?:\x20?\.\x20?|\x20{0,2}[\[({<]\x20?(?:[dD][oO][tT]|\.)\x20?[\])}>]\x20{0,2}|\x20{1,2}[dD][oO][tT]\x20{1,2})"
LABELS = re.compile(rf"[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)+")
STOP = re.compile(r"\.\x20")
NUMBER = re.compile(r"(?<![A-Za-z0-9])\+?\(?[0-9](?:[().\x20/-]{0,3}[0-9]){6,}+(?![A-Za-z0-9])")
GROUP = re.compile(r"[0-9]+")
CODE = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20-]?[A-Z0-9]){11,}")
#: Characters of the account codes of some countries.
CODE_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26,
}
CUES = (("mail", "contact", "write", "reach", "ask"), ("tel", "phone", "call", "fax", "mobile", "ring", "dial", "sms"), ("card", "visa", "pay", "account", "charge"), ("page", "pp.", "isbn", "version", "vol", "chapter", "rfc", "edition", "no."), ("born", "since", "until", "date", "on the", "between", "year"))
#: Last labels of common domains, and words that stand before "at" in prose.
ENDINGS = frozenset("com org net edu gov info biz int mil io ai app dev co me tv de fr uk es it nl be at ch pl cz se no dk fi pt eu us ca br mx in jp cn kr au nz ru za".split())
PROSE = frozenset("look looks looked looking meet meets met arrive arrives arrived be is are was were am been stay stays stayed stop stops stopped aim aimed point pointed sit sits sat work works worked live lives lived good best first last not only people it them him her us you me one all and or but that this there here now then day night laugh stare open closed start starts end ends sold held".split())
DATE = re.compile(r"(?:[12][0-9]{3}[-/. ][01]?[0-9][-/. ][0-3]?[0-9]|[0-3]?[0-9][-/. ][0-3]?[0-9][-/. ][12][0-9]{3})(?:[\x20T].*)?")
FEATURES = 45


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, one sign at a time: the local part is the whole run before it."""
    found, after, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            after = m.end()
        at = text.find("@", at + 1)
    return found


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """Spans ``(start, index of the kind, end)`` of the base kinds, sorted; null has none."""
    if not text:
        return []
    spans = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        spans += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups())]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = re.sub("[^0-9]", "", m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    spans.append((m.start(), 2, m.end()))
        if "+" in text:
            spans += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(spans)


def local_start(text: str, end: int, after: int) -> int | None:
    """Where the local part before a sign begins, parts spelled with "dot" included; nothing before ``after``."""
    start = end
    while start > after and text[start - 1] in LOCAL:
        start -= 1
    if start == end:
        return None
    while (m := DOT_BEFORE.search(text, max(after, start - 12), start)) and m.start() > after and text[m.start() - 1] in LOCAL:
        start = m.start()
        while start > after and text[start - 1] in LOCAL:
            start -= 1
    return start


def numbers(text: str) -> list[tuple[int, int]]:
    """Runs of at least seven digits in groups; of runs of over 15 digits also each series of whole groups of 9 to 19."""
    found = set()
    for m in NUMBER.finditer(text):
        groups = [(g.start(), g.end()) for g in GROUP.finditer(text, m.start(), m.end())]
        total = sum(e - s for s, e in groups)
        if total <= 19:
            open_only = text[m.start()] == "(" and ")" not in m[0]
            found.add((m.start() + open_only, m.end()))
        if total > 15:
            for i, (s, _) in enumerate(groups):
                have = 0
                for a, e in groups[i : i + 19]:
                    have += e - a
                    if have > 19:
                        break
                    if have >= 9:
                        found.add((s, e))
    return sorted(found)


def codes(text: str) -> list[tuple[int, int]]:
    """Account codes of the right length whose checksum holds, in one piece or in groups."""
    found = []
    for m in CODE.finditer(text):
        size, end, left = CODE_LENGTHS.get(m[0][:2], 0), m.start(), CODE_LENGTHS.get(m[0][:2], 0)
        while left and end < m.end():
            left -= text[end].isalnum()
            end += 1
        whole = not left and size and (end == len(text) or not text[end].isalnum())
        if whole and account_holds(re.sub("[^A-Z0-9]", "", text[m.start() : end])):
            found.append((m.start(), end))
    return found


def candidates(text: str | None) -> list[tuple[int, int, int]]:
    """Proposed spans of all generators, whole whatever their length; they may overlap each other and base spans."""
    if not text:
        return []
    found, after = [], 0
    for m in SIGN.finditer(text):
        end = BEFORE.search(text, max(after, m.start() - 4), m.start()).start()
        start = local_start(text, end, after)
        after = m.end()
        if start is not None and (d := LABELS.match(text, AFTER.match(text, m.end()).end())):
            found.append((start, 4, d.end()))
            # a full stop may end the sentence instead of a label
            stop = STOP.search(text, d.start(), d.end())
            if stop and LABELS.fullmatch(text, d.start(), stop.start()):
                found.append((start, 4, stop.start()))
    if DIGIT.search(text):
        found += [(s, 5, e) for s, e in numbers(text)]
        found += [(s, 6, e) for s, e in codes(text)]
    return sorted(found)


def account_holds(code: str) -> bool:
    """The checksum of an account code: its digits, letters counted from 10 on, leave 1 modulo 97."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


#: Forms to learn from and, in the second place, other forms to set thresholds and report figures on; each # is a digit.
EMAIL_FORMS = (
    ((" at ", " dot "), ("[at]", "[dot]"), (" (at) ", "."), (" @ ", "."), (" AT ", " DOT "), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" at ", ".")),
    ((" (at) ", " (dot) "), ("{at}", "{dot}"), (" [AT] ", "."), ("@ ", " . "), (" At ", " dot "), (" <at> ", " <dot> ")),
)
PHONE_FORMS = (
    ("(###) ###-####", "###.###.####", "### ### ####", "1 ### ### ####", "0### #######", "(###) ###.####", "0## ### ## ##", "(0###) ######", "00## ### ######", "0### ### ###", "(0##) #### ###", "0##/#######"),
    ("###-###-####", "(###)### ####", "0###/### ####", "1-###-###-####", "### / ###-####", "0#### ######", "(0##) ### ## ##", "0## #### ####"),
)
CARD_FORMS = ((".", "/", " / ", ". "), (" - ", " . ", "  "))
#: Lookalikes: {y} a year, {d} one or two digits, {n} three, {m} four, {w} a word.
LOOKALIKES = (
    (
        "on {y}-0{e}-1{e}", "dated 1{e}.0{e}.{y}", "pages {n} - {m}", "from {y} - {y}", "version {e}.{d}.{n}.{m}", "room {n}-{m}-{e}", "at 1{e}:{d} on {y}/1{e}/2{e}", "isbn 978-{e}-{d}-{n}{n}-{e}", "lost {d}.{n}.{n}", "{n} {n} {n} people", "{m} {m} {m}", "{y} {y} {y}",
        "item {m}{m}{e}", "no. {n}/{m}", "ratio {e}.{m}{m}", "met at {w} dot {w}", "look at {w}. {w} is", "stay at the {w} dot it", "{w} at {w}. {w} {w}", "{w} at {w} . {w}", "{w} at {w}. No {w}", "good at {w}. At last", "{w} sat at {w}. Be quick", "{w} at {w}. In the", "{w} at {w} dot {w}", "{w} (at) {w}. {w}", "sold at {w} . {w}", "is good at {w}. The {w}", "order {m}{m}", "score {n}-{n}-{n}", "born 0{e}/1{e}/{y}", "lines {m}-{m}",
    ),
    (
        "until {d}/{d}/{y}", "{y} to {y}, {n}-{n}", "vol. {d} ({y}) {n}-{n}", "rfc {m} {m}", "pi 3.{m}{m}", "build {y}.{d}.{d}.{n}", "worked at {w} dot matrix", "arrived at {w}. {w} went", "{n} x {m} x {n}", "years {y}/{y}", "serial {m}-{m}{e}", "be at {w} . then", "{w} {w} at {w}. It {w}", "{w} at the {w} . {w} dot {w}", "{n}.{n}.{n} euros", "born {y}-1{e}-0{e}", "pages {m} - {m}",
    ),
)
LEADS = (("", "", "{w} {w} ", "write to ", "contact: ", "call ", "tel. ", "my number is ", "card "), ("", "", "{w} and ", "reach me: ", "phone ", "ask ", "dial "))


def written(x: str, kind: int, held: int, pick: int) -> str:
    """A base match in another form; ``held`` chooses the family of forms."""
    digits = re.sub("[^0-9]", "", x)
    if kind == 0:
        (at, dot), (local, domain) = EMAIL_FORMS[held][pick % len(EMAIL_FORMS[held])], x.split("@", 1)
        return local + at + domain.replace(".", dot)
    if kind == 2:
        sep = CARD_FORMS[held][pick % len(CARD_FORMS[held])]
        return sep.join(digits[k : k + 4] for k in range(0, len(digits), 4))
    form, left = PHONE_FORMS[held][pick % len(PHONE_FORMS[held])], iter(digits[::-1] + digits)
    return "".join(next(left, "7") if c == "#" else c for c in form)


def invented(text: str, held: int, rng: np.random.Generator) -> list[tuple[str, str, int | None]]:
    """Lines (before, value, kind) of made-up emails, phones and cards, and of lookalikes (no kind)."""
    found = re.findall("[A-Za-z]{2,12}", text[:4000]) or ["word"]
    word = lambda: found[int(rng.integers(len(found)))].lower()
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))

    def fill(line: str) -> str:
        for mark, make in (("{w}", word), ("{y}", lambda: str(int(rng.integers(1900, 2031)))), ("{d}", lambda: number(2)), ("{n}", lambda: number(3)), ("{m}", lambda: number(4)), ("{e}", lambda: str(int(rng.integers(1, 10))))):
            while mark in line:
                line = line.replace(mark, make(), 1)
        return line

    local = word() + ("", ".", "_", number(2))[int(rng.integers(4))] + (word() if rng.random() < 0.5 else "x")
    domain = word() + (f".{word()}" if rng.random() < 0.3 else "") + "." + sorted(ENDINGS)[int(rng.integers(len(ENDINGS)))]
    card = "4" + number(14)
    card += next(str(k) for k in range(10) if luhn(card + str(k)))
    out: list[tuple[str, str, int | None]] = []
    for kind, x in ((0, f"{local}@{domain}"), (2, card), (3, "+1" + str(int(rng.integers(2, 10))) + number(9))):
        lead = LEADS[held][int(rng.integers(len(LEADS[held])))]
        out.append((fill(lead), written(x, kind, held, int(rng.integers(1 << 16))), kind))
    for _ in range(6):
        out.append((word() + " ", fill(LOOKALIKES[held][int(rng.integers(len(LOOKALIKES[held])))]), None))
    return out


def disguised(text: str, spans: list[tuple[int, int, int]], pick: int, held: int) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with its emails, cards and phones in other forms and invented lines at its end, and where the hidden ones are."""
    out, places, done, size = [], [], 0, 0

    def add(before: str, new: str, kind: int | None) -> None:
        nonlocal size
        out.extend((before, new))
        size += len(before)
        if kind is not None:
            places.append((size, kind, size + len(new)))
        size += len(new)

    for i, (s, kind, e) in enumerate(spans):
        if s >= done and kind != 1:
            add(text[done:s], written(text[s:e], kind, held, pick + i), kind)
            done = e
    add(text[done:], "\n", None)
    rng = np.random.default_rng(pick)
    for before, new, kind in invented(text, held, rng):
        add(before, new, kind)
        add("", (".\n", " and more\n", "\n", ", or so.\n")[int(rng.integers(4))], None)
    return "".join(out), places


def examples(text: str | None, pick: int, held: int = 0) -> tuple[list[list[float]], list[int]]:
    """Features and labels of the candidates that a text gives to learn from.

    A candidate that is a hidden span is positive, all others are negative, parts of
    hidden spans and what goes beyond them included.  Candidates on a base
    span are left out, as they are when texts are scanned, and so are account codes.
    """
    if not text:
        return [], []
    new, places = disguised(text, base_spans(text), pick, held)
    kept = merged(base_spans(new))
    exact = {(s, e) for s, _, e in places}
    rows, ys = [], []
    for c in candidates(new):
        if c[1] == 6 or overlaps(c, kept):
            continue
        rows.append(features(new, c))
        ys.append(int((c[0], c[2]) in exact))
    return rows, ys


def features(text: str, span: tuple[int, int, int]) -> list[float]:
    """Format of the span and its surroundings (24 characters before, 8 after)."""
    s, kind, e = span
    x, before, after = text[s:e], text[max(0, s - 24) : s].lower(), text[e : e + 8]
    digits = "".join(c for c in x if c.isdigit())
    groups = GROUP.findall(x)
    sizes = [len(g) for g in groups] or [0]
    labels = re.findall("[A-Za-z0-9._%+-]+", x)
    local, last = (labels[0].lower(), labels[-1].lower().rsplit(".", 1)[-1]) if labels else ("", "")
    seps = set(re.findall("[^0-9]+", x))
    years = [len(g) == 4 and "1900" <= g < "2100" for g in groups] or [False]
    return [
        float(kind), float(len(x)), float(len(digits)), float(sum(c.isalpha() for c in x)),
        len(digits) / len(x), float(len(groups)), float(max(sizes)), float(min(sizes)), float(sizes[0]), float(sizes[-1]),
        float(x.count(".")), float(x.count("-")), float(x.count("(")), float(x[0] == "+"),
        float(bool(before) and before[-1].isalnum()), float(bool(after) and after[0].isalnum()),
        *(float(any(c in before for c in cue)) for cue in CUES),
        float(len(set(digits))), float(before.rstrip()[-1:] in (":", "=")),
        float(last in ENDINGS), float(len(last)), float(len(labels)), float("@" in x), float(any(c in x for c in "[({<")), float(bool(re.search("(?i)dot", x))), float(local in PROSE), float(len(local)), float(any(c in "._" or c.isdigit() for c in local)),
        float(DATE.fullmatch(x) is not None), float(sum(years)), float(years[0]), float(len(seps)), float(x.count("/")), float(14 <= len(digits) <= 19 and luhn(digits)), float(sizes == [3, 3, 4] or sizes == [1, 3, 3, 4]), float(len(groups) == 2 and sizes[0] == sizes[-1]),
        float(before.rstrip(" .-/(")[-1:].isdigit()), float(after.lstrip(" .-/)")[:1].isdigit()), float(bool(labels) and labels[-1][:1].isupper() and not labels[-1].isupper()), float(digits[:1] == "0"), float(digits[:2] == "00"),
    ]


@dataclass
class Trees:
    """Complete binary trees of one depth, level by level, and by kind thresholds and held-out figures.

    ``report`` has precision (None if nothing is taken), recall (None without positives),
    positives and candidates of each added kind, on forms not learned from.
    """

    split: np.ndarray
    at: np.ndarray
    value: np.ndarray
    bias: float
    least: dict[int, float]
    report: dict[str, tuple[float | None, float | None, int, int]]

    def score(self, x: np.ndarray) -> np.ndarray:
        z, depth = np.full(len(x), self.bias), int(math.log2(self.value.shape[1]))
        rows = np.arange(len(x))
        for split, at, value in zip(self.split, self.at, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, split[node]] > at[node])
            z += value[node - (2**depth - 1)]
        return 1 / (1 + np.exp(-z))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss on quantile-binned features."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], 1)
    width = max(len(c) for c in cuts) + 1
    bias = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    z, made = np.full(len(y), bias), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        split, at, node = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            best = np.zeros(n)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                key = (node - first) * width + bins[:, f]
                gl = np.bincount(key, g, n * width).reshape(n, width).cumsum(1)
                hl = np.bincount(key, h, n * width).reshape(n, width).cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = (gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge))[:, : len(c)]
                k = gain.argmax(1)
                better = gain[np.arange(n), k] > best + 1e-9
                best = np.where(better, gain[np.arange(n), k], best)
                split[first : first + n] = np.where(better, f, split[first : first + n])
                at[first : first + n] = np.where(better, c[k], at[first : first + n])
            node = 2 * node + 1 + (x[np.arange(len(y)), split[node]] > at[node])
        leaf = node - (2**depth - 1)
        value = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        z += value[leaf]
        made.append((split, at, value))
    return Trees(*(np.array(a) for a in zip(*made, strict=True)), bias, {}, {})


def merged(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans cover, ascending."""
    starts: list[int] = []
    ends: list[int] = []
    for s, _, e in sorted(spans):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def overlaps(span: tuple[int, int, int], stretches: tuple[list[int], list[int]]) -> bool:
    starts, ends = stretches
    at = bisect_left(starts, span[2]) - 1
    return at >= 0 and ends[at] > span[0]


def fit(documents: DataFrame, sample_documents: int = 20_000, sample_candidates: int = 40_000, precision: float = 0.97) -> Trees | None:
    """Fit on the candidates of a bounded sample of documents (the first by hash of the id).

    A quarter of the documents is held out, with forms and lookalikes of their own; per
    kind the threshold lies half way below the least score from which on the held-out
    precision is at least ``precision``, at 0.5 or more, and ``report`` keeps the
    held-out precision and recall there.  None without candidates of both labels.  At
    most ``sample_candidates`` rows of features reach the driver.  Rows that repeat an
    id are all taken, as far as the bounds go.
    """
    ids = documents.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_documents)

    def work(texts: list[str | None], held: int) -> dict[str, list]:
        found = [examples(t, len(t or "") + (zlib.crc32((t or "").encode("utf-8", "replace")) << 8), held) for t in texts]
        return {"x": [[v for r in rows for v in r] for rows, _ in found], "y": [ys for _, ys in found]}

    sample = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")
    quarter = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 3
    both = []
    for held in (0, 1):

        def of_family(texts: list[str | None], held: int = held) -> dict[str, list]:
            return work(texts, held)

        both.append(map_texts(sample.filter(quarter if held else ~quarter), of_family, "x array<double>, y array<int>"))
    found = both[0].unionByName(both[1]).select("doc_id", F.xxhash64("doc_id").alias("o"), "x", F.posexplode("y").alias("pos", "y"))
    found = found.select("o", "doc_id", "pos", "y", F.slice("x", F.col("pos") * FEATURES + 1, FEATURES).alias("x"))
    rows = found.orderBy("o", "doc_id", "pos", "x").limit(sample_candidates).select((F.pmod("o", F.lit(4)) == 3).alias("held"), "y", "x").collect()
    y, held = np.array([r["y"] for r in rows], float), np.array([r["held"] for r in rows], bool)
    if not len(y) or not 0 < y[~held].sum() < (~held).sum():
        return None
    x = np.array([r["x"] for r in rows], float)
    model = boost(x[~held], y[~held])
    p = model.score(x[held]) if held.any() else np.empty(0)
    for kind in (4, 5):
        mine = x[held][:, 0] == kind
        order = np.argsort(-p[mine], kind="stable")
        ys, ps = y[held][mine][order], p[mine][order]
        sure = np.append(ps[1:] < ps[:-1], True) if len(ps) else np.empty(0, bool)  # a threshold takes all equal scores
        good = np.nonzero((ys.cumsum() / (np.arange(len(ys)) + 1) >= precision) & sure & (ps >= 0.5))[0]
        lower = np.append(ps[1:], 0.0)
        model.least[kind] = max(0.5, float(ps[good[-1]] + lower[good[-1]]) / 2) if len(good) and ys.sum() else math.inf
        taken = ys[ps >= model.least[kind]]
        model.report[KINDS[kind]] = (float(taken.mean()) if len(taken) else None, float(taken.sum() / ys.sum()) if ys.sum() else None, int(ys.sum()), len(ys))
    return model


def find(text: str | None, model: Trees | None) -> list[tuple[int, int, int]]:
    """Base spans, and the selected candidates that overlap none of them nor a better one; valid account codes come first."""
    base = base_spans(text)
    stretches = merged(base)
    proposed = [c for c in candidates(text) if not overlaps(c, stretches)]
    scored = [c for c in proposed if c[1] != 6] if model else []
    scores = model.score(np.array([features(text, c) for c in scored])).tolist() if scored else []
    ranked = [(-2.0, c) for c in proposed if c[1] == 6] + [(-p, c) for p, c in zip(scores, scored, strict=True) if p >= model.least[c[1]]]
    starts: list[int] = []
    chosen: list[tuple[int, int, int]] = []
    for _, c in sorted(ranked):
        at = bisect_left(starts, c[2])
        if not (at and chosen[at - 1][2] > c[0]):
            starts.insert(at, c[0])
            chosen.insert(at, c)
    return sorted(base + chosen)


def scan(documents: DataFrame, model: Trees | None) -> DataFrame:
    """Per row: doc_id, the number of each base kind, ``base`` and ``spans`` as text.

    Null and empty texts have no spans.  Rows are independent: repeated rows give
    repeated results, an empty table an empty result; other columns are not read.
    """

    def work(texts: list[str | None]) -> dict[str, list]:
        found = [find(t, model) for t in texts]
        base = [[s for s in f if s[1] < N_BASE] for f in found]
        counts = {f"n_{KINDS[k]}": [sum(s[1] == k for s in f) for f in base] for k in range(N_BASE)}
        return {**counts, "base": [span_key(f, KINDS) for f in base], "spans": [span_key(f, KINDS) for f in found]}

    return map_texts(documents, work, "n_email long, n_ip long, n_card long, n_phone long, base string, spans string")
