"""Personal data by fixed rules and a semi-Markov conditional random field.

Base spans (email, ip, card, phone) come from four patterns with checks and
always stay.  The field adds spans of personal data in other spellings
(``name [at] host [dot] org``, numbers without country code, grouped cards of
other lengths, IPv6, credentials): whole-span features (shapes, digit counts,
check digits, words just before the span) score candidate segments of at most
``MAX_TOKENS`` tokens, and dynamic programming over the segments jointly
chooses boundaries and types.  Candidates that touch a base span are left out,
as those are settled.

A candidate is a segment between token borders, on one line, that has a shape,
and three digits or a spelled-out at-sign.  Every candidate of a text is
listed, from runs of the characters that its shape may hold; words outside of
such runs are in no candidate and score nothing.  Listing and decoding are
linear in the text, whatever it holds.

The field is trained here, on generated sentences with a fixed seed, by
gradient ascent on the conditional log-likelihood with the forward-backward
sums of a semi-Markov chain.

Defined cases: null text is empty; empty text has no spans; offsets are code
points, ends exclusive; repeated rows are judged alike; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import exp, inf, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
MAX_TOKENS = 24

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only start where a run of digits starts, which keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")

Span = tuple[int, int, int]  # kind (index), start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern, found from each at-sign (the pattern itself is quadratic on long runs)."""
    done, at = 0, text.find("@")
    while at >= 0:
        tail = _DOMAIN.match(text, at + 1)
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        if tail and start < at:
            yield start, tail.end()
            done = tail.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if "@" in text:
        out += [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(digits_of(m.group())) <= 15:
                out.append((3, m.start(), m.end()))
    return out


# --- the field ---------------------------------------------------------------

_TOKEN = re.compile(r"[^\W_]+|[^\s]")
_SHAPES = {
    "phone_groups": re.compile(r"(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,4}){2,4}"),
    "card_groups": re.compile(r"[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,3})?"),
    "plain_digits": re.compile(r"[0-9]+"),
    "date": re.compile(r"(?:[0-9]{4}[ ./-][0-9]{1,2}[ ./-][0-9]{1,2}|[0-9]{1,2}[ ./-][0-9]{1,2}[ ./-][0-9]{4})(?: [0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)?"),
    "decimal": re.compile(r"[0-9]+[.][0-9]+"),
    "ipv6": re.compile(r"(?:[0-9a-fA-F]{1,4}:){2,7}:?(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4})*)?"),
    "hex_long": re.compile(r"[0-9a-f]{32,}|[0-9A-F]{32,}"),
    "mixed_long": re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9_/+-]{20,}"),
    "credential": re.compile(r"AKIA[0-9A-Z]{12,}|ghp_[0-9A-Za-z]{20,}|sk-[0-9A-Za-z-]{16,}|xox[bp]-[0-9A-Za-z-]{10,}"),
}
#: Shapes of groups of digits: any segment between token borders may have them, of this many groups and, beyond two groups, characters at most.
_DIGIT_SHAPES, _MOST_GROUPS, _MOST_CHARS = ("phone_groups", "card_groups", "plain_digits", "date", "decimal"), 6, 40
_ANY_DIGITS = re.compile("|".join(f"(?:{_SHAPES[k].pattern})" for k in _DIGIT_SHAPES))
_DIGIT_RUN = re.compile(r"[0-9(+][0-9 ./()+:-]*")
_DIGITS = re.compile(r"[0-9]+")
#: Credentials are whole runs of these characters, from letter or digit to letter or digit; addresses likewise.
_LONG_RUN = re.compile(r"[A-Za-z0-9][A-Za-z0-9_/+-]{14,}")
_HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]++:[0-9A-Fa-f:]++")
#: A spelled-out at-sign after a local part, and what follows: a label, then spelled-out or plain dots with labels.
_AT_SIGN = re.compile(r"(?<=[A-Za-z0-9._%+-])(?=((?:\s?[\[(]\s?(?:at|AT|@)\s?[\])]\s?|\s(?:at|AT|@)\s)[A-Za-z0-9]))")
_BRACKETED = re.compile(r"\s?[\[(]")
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_DOT = re.compile(r"(?:\s?[\[(]\s?(?:dot|DOT|\.)\s?[\])]\s?|\s(?:dot|DOT)\s|\.)(?=[A-Za-z0-9-])")
_SPELLED_DOT = re.compile(r"\b(?:dot|DOT)\b")
_CUES = {
    "cue_email": r"(?:e-?mail|contact|write|reach)\W",
    "cue_ip": r"(?:\bip|host|addr\w*|server)\W",
    "cue_card": r"(?:card|visa|amex|credit)\W",
    "cue_phone": r"(?:tel|phone|call|fax|mobile|number)\W",
    "cue_secret": r"(?:token|secret|key|password|passwd|api)\W",
}
_ANY_CUE = re.compile("|".join(_CUES.values()), re.I)
_CUES = {k: re.compile(v, re.I) for k, v in _CUES.items()}
_ENDINGS = re.compile(r"(?:com|org|net|edu|gov|io|de|fr|es|uk)$", re.I)
_SWITCH = re.compile(r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")
FEATURES = (
    "bias", "obfuscated", "bracketed", "spelled", "ending", *_SHAPES, "luhn", "digits_7_9", "digits_10", "digits_11_12", "digits_13_15", "digits_16_19",
    "digits_20", "parenthesis", "leading_00", "leading_plus", *_CUES, "inside_word", "many_switches", "separated", "both_cases",
)
_AT = {f: i for i, f in enumerate(FEATURES)}
_DIGIT_COUNTS = (("digits_7_9", 7, 9), ("digits_10", 10, 10), ("digits_11_12", 11, 12), ("digits_13_15", 13, 15), ("digits_16_19", 16, 19), ("digits_20", 20, 10**9))


def _border(text: str, at: int) -> bool:
    """Whether a token may begin or end here: not between two letters or digits."""
    return at <= 0 or at >= len(text) or not (text[at - 1].isalnum() and text[at].isalnum())


def _few_tokens(text: str, start: int, end: int) -> bool:
    """At most MAX_TOKENS tokens, on one line."""
    n = 0
    for _ in _TOKEN.finditer(text, start, end):
        n += 1
        if n > MAX_TOKENS:
            return False
    return "\n" not in text[start:end]


def _obfuscated(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """Addresses with a spelled-out at-sign; the local part and all labels are whole, the domain may end after any of its labels but the first."""
    for m in _AT_SIGN.finditer(text):
        core, start = m.end(1) - 1, m.start()
        floor = max(0, start - 200 * MAX_TOKENS)
        while start > floor and _LOCAL.match(text[start - 1]):
            start -= 1
        while start < m.start() and not ("0" <= text[start] <= "9" or "A" <= text[start] <= "Z" or "a" <= text[start] <= "z"):
            start += 1
        if start == m.start() or not _border(text, start):
            continue
        label, names = _LABEL.match(text, core), ["obfuscated"]
        if _BRACKETED.match(text, m.start()):
            names.append("bracketed")
        at = label.end()
        while dot := _DOT.match(text, at):
            at = _LABEL.match(text, dot.end()).end()
            end = at
            while text[end - 1] == "-":
                end -= 1
            if end > dot.end() and _border(text, end):
                if not _few_tokens(text, start, end):
                    break
                yield start, end, names
            elif not _few_tokens(text, start, at):
                break


def _digit_segments(text: str) -> Iterator[tuple[int, int, list[str]]]:
    for run in _DIGIT_RUN.finditer(text):
        groups = [g.span() for g in _DIGITS.finditer(text, run.start(), run.end())]
        if not groups or sum(e - s for s, e in groups) < 3:
            continue
        for k, (s, _) in enumerate(groups):
            starts = [s] if _border(text, s) else []
            if s > run.start() and text[s - 1] in "(+":
                starts.append(s - 1)
            for start in starts:
                digits = 0
                for j in range(k, min(len(groups), k + _MOST_GROUPS)):
                    end = groups[j][1]
                    if j > k + 1 and end - start > _MOST_CHARS:
                        break
                    digits += end - groups[j][0]
                    if digits >= 3 and _border(text, end) and _ANY_DIGITS.fullmatch(text, start, end):
                        yield start, end, [n for n in _DIGIT_SHAPES if _SHAPES[n].fullmatch(text, start, end)]


def _whole_runs(text: str) -> Iterator[tuple[int, int, list[str]]]:
    for m in _LONG_RUN.finditer(text):
        start, end = m.start(), m.start() + len(m.group().rstrip("_/+-"))
        yield start, end, [n for n in ("hex_long", "mixed_long", "credential") if _SHAPES[n].fullmatch(text, start, end)]
    if ":" in text:
        for m in _HEX_RUN.finditer(text):
            start, end = m.span()
            if text[end - 1] == ":" and text[end - 2] != ":":
                end -= 1
            yield start, end, ["ipv6"] if end - start < 64 and _SHAPES["ipv6"].fullmatch(text, start, end) else []


def shaped(text: str) -> dict[tuple[int, int], list[str]]:
    """Every candidate segment (start, end) and the names of its shapes."""
    out: dict[tuple[int, int], list[str]] = {}
    for start, end, names in _obfuscated(text):
        out[start, end] = [*names]
    for start, end, names in _digit_segments(text):
        out.setdefault((start, end), []).extend(names)
    for start, end, names in _whole_runs(text):
        if names and _border(text, start) and _border(text, end) and sum("0" <= c <= "9" for c in text[start:end]) >= 3 and _few_tokens(text, start, end):
            out.setdefault((start, end), []).extend(names)
    return out


def cues(text: str, start: int) -> list[str]:
    before = text[max(0, start - 24) : start]
    return [name for name, cue in _CUES.items() if cue.search(before)] if _ANY_CUE.search(before) else []


def span_features(text: str, start: int, end: int, shapes: list[str], before: list[str]) -> tuple[int, ...]:
    """Features of a whole span with these shapes, after these cues."""
    s, out = text[start:end], ["bias", *shapes, *before]
    if "obfuscated" in shapes:
        if _SPELLED_DOT.search(s):
            out.append("spelled")
        if _ENDINGS.search(s):
            out.append("ending")
    d = digits_of(s)
    if len(d) >= 12 and luhn(d):
        out.append("luhn")
    out += [name for name, lo, hi in _DIGIT_COUNTS if lo <= len(d) <= hi]
    if "(" in s:
        out.append("parenthesis")
    if s.startswith("00"):
        out.append("leading_00")
    if s.startswith("+"):
        out.append("leading_plus")
    if (start and (text[start - 1].isalnum() or text[start - 1] in "+-_@/.:")) or (end < len(text) and (text[end].isalnum() or text[end] in "-_@/:")) or (end + 1 < len(text) and text[end] == "." and text[end + 1].isalnum()):
        out.append("inside_word")
    if "mixed_long" in shapes:
        if len(_SWITCH.findall(s)) >= 5:
            out.append("many_switches")
        if any(c in s for c in "_/-"):
            out.append("separated")
        if s.lower() != s and s.upper() != s:
            out.append("both_cases")
    return tuple(sorted(_AT[name] for name in out))


@dataclass(frozen=True)
class Candidate:
    start: int  # code point
    end: int
    features: tuple[int, ...]


def candidates(text: str, taken: list[Span] = ()) -> list[Candidate]:
    """The candidate segments of a text that touch no taken span, by end, then start."""
    found = sorted(shaped(text).items(), key=lambda x: (x[0][1], x[0][0]))
    if not found:
        return []
    ends, reach = [], []  # taken spans by start, and the farthest end so far
    for _, a, b in sorted(taken, key=lambda x: x[1]):
        ends.append(a)
        reach.append(max(b, reach[-1]) if reach else b)
    out, known = [], {}
    for (start, end), shapes in found:
        i = bisect_left(ends, end)  # of those that begin before this end, does any reach beyond its start?
        if i and reach[i - 1] > start:
            continue
        if start not in known:
            known[start] = cues(text, start)
        out.append(Candidate(start, end, span_features(text, start, end, shapes, known[start])))
    return out


class Field:
    """Weights (types by features), and the best type of each set of features met so far."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights
        self.known: dict[tuple[int, ...], tuple[int, float]] = {}

    def best(self, features: tuple[int, ...]) -> tuple[int, float]:
        if features not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            scores = self.weights[:, list(features)].sum(axis=1)
            k = int(np.argmax(scores))
            self.known[features] = k, float(scores[k])
        return self.known[features]


def decode(found: list[Candidate], field: Field) -> list[tuple[Candidate, int]]:
    """Best segmentation: every token is outside or in one segment of one type; ties prefer outside, then the earlier candidate and type."""
    ends, best, back = [0], [0.0], [None]  # best score of what ends at or before each place
    for c in found:  # by end
        if c.end > ends[-1]:
            ends.append(c.end)
            best.append(best[-1])
            back.append(None)
        before = bisect_left(ends, c.start + 1) - 1
        k, score = field.best(c.features)
        if best[before] + score > best[-1]:
            best[-1], back[-1] = best[before] + score, (c, k, before)
    out, i = [], len(ends) - 1
    while i > 0:
        if back[i]:
            out.append(back[i][:2])
            i = back[i][2]
        else:
            i -= 1
    return out[::-1]


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -inf else a + log(1 + exp(b - a))


def _expected(found: list[Candidate], weights: np.ndarray) -> np.ndarray:
    """Posterior probability of each (candidate, type), by forward and backward sums."""
    scores = np.array([weights[:, list(c.features)].sum(axis=1) for c in found]).reshape(len(found), len(KINDS))
    total = np.log(np.exp(scores).sum(axis=1))
    places = sorted({p for c in found for p in (c.start, c.end)})  # what lies between two places is outside at no score
    n, at = len(places) - 1, {p: i for i, p in enumerate(places)}
    ahead, behind = [0.0] + [-inf] * n, [-inf] * n + [0.0]
    by_end: dict[int, list[int]] = {}
    by_start: dict[int, list[int]] = {}
    for i, c in enumerate(found):
        by_end.setdefault(at[c.end], []).append(i)
        by_start.setdefault(at[c.start], []).append(i)
    for i in range(1, n + 1):
        ahead[i] = ahead[i - 1]
        for k in by_end.get(i, ()):
            ahead[i] = _log_add(ahead[i], ahead[at[found[k].start]] + total[k])
    for i in range(n - 1, -1, -1):
        behind[i] = behind[i + 1]
        for k in by_start.get(i, ()):
            behind[i] = _log_add(behind[i], behind[at[found[k].end]] + total[k])
    around = np.array([ahead[at[c.start]] + behind[at[c.end]] - ahead[n] for c in found])
    return np.exp(scores + around[:, None])


def training_sentences(n: int = 420, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Generated sentences with their spans, and as many look-alikes without any."""
    draw = np.random.default_rng(seed)
    pick = lambda *x: x[int(draw.integers(len(x)))]
    digits = lambda k: "".join(map(str, draw.integers(0, 10, k)))
    word = lambda: "".join(pick(*"bcdfglmnprst") + pick(*"aeiou") for _ in range(int(draw.integers(1, 4))))
    hexes = lambda k: "".join(draw.choice(list("0123456789abcdef"), k))

    def card(k: int) -> str:
        body = digits(k - 1)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def entity() -> tuple[int, str, str]:
        kind = int(draw.integers(0, 5))
        if kind == 0:
            at, dot = pick((" [at] ", " [dot] "), (" (at) ", " (dot) "), (" at ", " dot "), (" AT ", " DOT "), ("[at]", "[dot]"))
            return kind, pick("email ", "contact ", "", "write to "), word() + at + word() + dot + pick("com", "org", "net", "de")
        if kind == 1:
            return kind, pick("ip ", "host ", "", "address "), ":".join(hexes(4) for _ in range(8)) if pick(0, 1) else "2001:db8::" + hexes(4)
        if kind == 2:
            c = card(15)
            return kind, pick("card ", "visa ", "", "amex "), pick(c, f"{c[:4]} {c[4:10]} {c[10:]}", f"{c[:4]}-{c[4:10]}-{c[10:]}")
        if kind == 3:
            a, b, c = digits(3), digits(3), digits(4)
            return kind, pick("tel ", "call ", "phone: ", ""), pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{digits(2)} {a} {b} {c}", f"+{digits(1)} ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}")
        mixed = "".join(draw.choice(list("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz0123456789"), int(draw.integers(22, 44)))) + digits(3)
        return 4, pick("token = \"", "key: ", "secret ", "password = '"), pick(hexes(40), hexes(32), "AKIA" + digits(4) + "QWERTYUIOPAS", "ghp_" + hexes(30), "sk-" + hexes(24), mixed)

    def lookalike() -> str:
        return pick(
            f"20{digits(2)}-0{digits(1)}-1{digits(1)}", digits(5), f"{digits(3)}.{digits(2)}", f"{word()} at {word()} dot", f"{word()} at {word()}.com", f"{word()} at {word()}. {word()}", digits(12), f"{digits(2)}:{digits(2)}:{digits(2)}",
            f"{word()}{word()}-{word()}-20{digits(2)}-{word()}{word()}-{digits(2)}", f"{word()}_{word()}{word()}_{digits(3)}_{word()}{word()}", f"{word()}{word()}/20{digits(2)}/{word()}{word()}/{word()}{digits(2)}",
            f"{word()} the dot {word()}", f"v{digits(1)}.{digits(2)}.{digits(1)}", hexes(12), f"1{digits(1)}.0{digits(1)}.20{digits(2)}", digits(9), f"{digits(4)} {digits(2)}", f"meet at {word()}", digits(16), digits(15),
        )

    out = []
    for i in range(n):
        text, spans = " ".join(word() for _ in range(int(draw.integers(2, 6)))) + " ", []
        if i % 2:
            kind, cue, value = entity()
            text += cue
            spans.append((kind, len(text), len(text) + len(value)))
            text += value + pick(" ", '" ', ", ", ". ")
        else:
            text += lookalike() + " "
        text += " ".join(word() for _ in range(int(draw.integers(1, 5)))) + "."
        out.append((text, spans))
    return out


@lru_cache(maxsize=1)
def trained_weights(epochs: int = 60, rate: float = 0.5, decay: float = 2e-3) -> np.ndarray:
    """Weights (types by features) fitted to the generated sentences."""
    data = []
    for text, spans in training_sentences():
        found = candidates(text)
        gold = {(s, e): k for k, s, e in spans}
        data.append((found, [(i, gold[c.start, c.end]) for i, c in enumerate(found) if (c.start, c.end) in gold]))
    weights = np.zeros((len(KINDS), len(FEATURES)))
    weights[:, 0] = -1.0
    for _ in range(epochs):
        gradient = -decay * len(data) * weights
        for found, gold in data:
            if not found:
                continue
            expected = _expected(found, weights)
            for i, c in enumerate(found):
                gradient[:, c.features] -= expected[i][:, None]
            for i, k in gold:
                gradient[k, found[i].features] += 1.0
        weights = weights + rate * gradient / np.sqrt(len(data)) / 8
    weights.setflags(write=False)
    return weights


def find_spans(text: str | None, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, by kind and start."""
    text = text or ""
    base = sorted(base_spans(text))
    added = [(k, c.start, c.end) for c, k in decode(candidates(text, base), field)]
    return base, sorted({*base, *added})


def spell(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_spans long"


def detect(documents: DataFrame) -> DataFrame:
    """The columns of the query, one row per document, then how many secrets and how many spans in all."""
    shared = documents.sparkSession.sparkContext.broadcast(np.array(trained_weights()))
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(shared.value)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                base, every = find_spans(text.as_py(), field)
                counts = [0] * len(BASE_KINDS)
                for k, _, _ in base:
                    counts[k] += 1
                secrets = sum(k == KINDS.index("secret") for k, _, _ in every)
                rows.append((*counts, hashlib.sha256(spell(base).encode()).hexdigest(), spell(every), secrets, len(every)))
            cols = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, kind) for c, kind in zip(cols, kinds))], names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
