"""Personal data with a semi-Markov conditional random field.

Two layers. The base layer finds e-mail, ip, card and phone spans by fixed patterns. The model layer scores whole candidate segments of up
to ``MOST_TOKENS`` tokens with features of the span as a whole (shape, digit count, check digit, separators, the words before it),
and each pair of neighbouring labels has a weight (``none``, the label of single tokens, included), so a segment's kind depends on what stands beside it. A semi-Markov Viterbi search with
that bound on entity length, whose state is the last label, chooses boundaries and kinds jointly. Base spans are kept as they
are; the model only labels tokens outside them (obfuscated addresses, phone numbers without a plus sign, grouped numbers).

The weights are trained here, on the driver: :func:`train` maximises the conditional likelihood of generated sentences by stochastic gradient descent,
with the segment forward-backward recursions. Generation is seeded, so every run has the same weights.

Only stretches around an at-word, or around enough digits within ``MOST_TOKENS`` tokens, can hold an entity, so the search runs there; texts are scanned
whole. A stretch begins and ends with tokens that no entity can hold (two such tokens have no weight as a pair); it has all tokens of any segment that holds its digits or at-word, and the tokens beside it that features look at, however many characters
they have; so cutting changes no result.

Defined results: a null or empty text has no spans. Offsets are code points, ends exclusive. Repeated rows give equal results, an empty table gives none, null ids are kept, and other columns are
ignored; a column to keep that is named like one of the result is an error.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from tarn.llm.batches import map_rows, refuse_names

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the base layer; the empty alternative consumes a digit run that can't start a match, so long runs stay linear.
IP = re.compile(r"[0-9]++(?:((?:\.[0-9]+){3})|)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their at-signs so that a long run without one costs nothing."""
    found, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """The spans of the base layer by kind."""
    if not text:
        return {k: [] for k in KINDS}
    found = {"email": emails(text), "ip": [], "card": [], "phone": []}
    for m in IP.finditer(text):
        if m[1] and all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")):
            found["ip"].append(m.span())
    for m in CARD.finditer(text):
        if 12 <= m.end() - m.start() and 12 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
            found["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(only_digits(m[0])) <= 15:
                found["phone"].append(m.span())
    return found


# ---- the model ----

#: Longest entity in tokens.
MOST_TOKENS = 22
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\s]|\s")
#: What can make a segment an e-mail address: an at-sign, or a spelled-out one.
AT = re.compile(r"@|[\[({<]\s?at\s?[\])}>]| at (?=[a-z0-9-]++(?:\.[a-z]| dot ))", re.IGNORECASE)
DIGITS = re.compile(r"[0-9]+")
#: Digits that any other entity has at least, and the tokens beside a segment that features look at.
LEAST_DIGITS, TOKENS_BEFORE, TOKENS_BEHIND = 7, 8, 4
#: Where no segment goes on: a line break, a tabulator or two blanks.
BREAK = re.compile(r"[\n\r\t]|\s\s")
#: The form of a written-out address: a bare "at" needs a "dot" or a full stop without a blank behind it.
MAIL = re.compile(r"[a-z0-9._%+-]+( ?@ ?| ?[\[({<] ?at ?[\])}>] ?| at )[a-z0-9-]+((\.| ?[\[({<] ?dot ?[\])}>] ?| dot )[a-z0-9-]+)+")
#: Words that announce an entity (features, not rules).
CUES = {
    "email": frozenset("email e-mail mail contact write courriel correo".split()),
    "ip": frozenset("ip host address server addr".split()),
    "card": frozenset("card visa mastercard amex credit payment tarjeta carte karte".split()),
    "phone": frozenset("phone tel telephone call mobile fax cell telefon teléfono téléphone".split()),
}
LABELS = ("none", *KINDS)


def tokens_of(text: str) -> list[tuple[str, int, int]]:
    return [(m[0], m.start(), m.end()) for m in TOKEN.finditer(text)]


def features(words: list[str], a: int, b: int) -> list[str]:
    """Features of the segment words[a:b] as a whole."""
    span = "".join(words[a:b])
    if b - a == 1 and not span.isdigit():
        return ["one"]
    first, last = words[a], words[b - 1]
    digits = only_digits(span)
    n = len(digits)
    letters = sum(c.isalpha() for c in span)
    shape = re.sub(r"[0-9]+", lambda m: str(min(len(m[0]), 6)), re.sub(r"[A-Za-z]+", "a", span))
    low = span.lower()
    out = [f"n={min(n, 20)}", f"letters={min(letters, 3)}", f"first={first if not first.isalnum() else 'd' if first.isdigit() else 'a'}", f"last={last if not last.isalnum() else 'd' if last.isdigit() else 'a'}"]
    if not letters:
        out.append(f"shape={shape}")
        out.append("sep=" + "".join(sorted(set(span) - set("0123456789")))[:4])
        if 12 <= n <= 19:
            out.append(f"luhn={luhn(digits)}")
        groups = re.findall("[0-9]+", span)
        out.append("groups=" + "-".join(str(min(len(g), 6)) for g in groups[:6]))
        if len(groups) == 4 and all(len(g) <= 3 for g in groups):
            out.append(f"octets={all(int(g) <= 255 for g in groups)}")
    elif MAIL.fullmatch(low):
        out.append("mailform")
    if "@" in span:
        out.append("at")
    near = {w.lower() for w in words[max(0, a - TOKENS_BEFORE) : a]}
    out += [f"cue={k}" for k, cues in CUES.items() if near & cues]
    before, after = words[a - 1] if a else " ", words[b] if b < len(words) else " "
    out.append(f"edge={before.isalnum()}{after.isalnum()}")
    if (before in ".-" and a > 1 and words[a - 2].isdigit()) or (after in ".-" and b + 1 < len(words) and words[b + 1].isdigit()):
        out.append("cut")
    rest = "".join(words[b : b + TOKENS_BEHIND]).lower()
    if letters and (re.match(r"(\.|-|_| dot | ?[\[({<] ?dot)\w?", rest) and not re.match(r"\.( |$)", rest) or (before in "._%+-" and a > 1 and words[a - 2].isalnum())):
        out.append("cutmail")
    return out


def possible(words: list[str], a: int, b: int) -> bool:
    """Whether words[a:b] can be an entity at all by its first and last token."""
    first, last = words[a], words[b - 1]
    if first.isspace() or last.isspace() or not last.isalnum() or not (first.isalnum() or first in "(+"):
        return False
    return True


def candidates(words: list[str]) -> list[tuple[int, int]]:
    out = []
    for a in range(len(words)):
        if words[a].isspace():
            continue
        digits, at, blanks = 0, False, 0
        for b in range(a + 1, min(len(words), a + MOST_TOKENS) + 1):
            w = words[b - 1]
            if w in "\n\r\t":
                break
            blanks = blanks + 1 if w.isspace() else 0
            if blanks > 1:
                break
            digits += len(w) if w.isdigit() else 0
            at |= w == "@" or w.lower() == "at"
            if (digits >= LEAST_DIGITS or at) and possible(words, a, b) and (not at or MAIL.fullmatch("".join(words[a:b]).lower())):
                out.append((a, b))
    return out


class Model:
    """Weights by (feature, kind) and by pairs of labels, the kinds and then ``none``; a token that is ``none`` scores zero, and so do two of them."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.weights = np.zeros((0, len(KINDS)))
        self.pairs = np.zeros((len(KINDS) + 1, len(KINDS) + 1))

    def index(self, names: list[str], grow: bool = False) -> list[int]:
        if grow:
            for x in names:
                self.at.setdefault(x, len(self.at))
            if len(self.at) > len(self.weights):
                self.weights = np.concatenate([self.weights, np.zeros((max(256, len(self.at)), len(KINDS)))])
        return [self.at[x] for x in names if x in self.at]

    def score(self, words: list[str], spans: list[tuple[int, int]], grow: bool = False) -> tuple[np.ndarray, list[list[int]]]:
        rows = [self.index(features(words, a, b) + ["bias"], grow) for a, b in spans]
        return np.array([self.weights[r].sum(0) for r in rows]).reshape(len(spans), len(KINDS)), rows

    def decode(self, words: list[str], banned: list[bool] | None = None) -> list[tuple[int, int, str]]:
        """Semi-Markov Viterbi: the labelled segmentation of highest score, as its entity segments."""
        spans = [s for s in candidates(words) if banned is None or not any(banned[s[0] : s[1]])]
        if not spans:
            return []
        scores, _ = self.score(words, spans)
        none, n, pairs = len(KINDS), len(words), self.pairs
        # a segment that can't make up for the single tokens in its place, whatever stands beside it, is left out
        hope = scores + pairs[:, :none].max(0) + pairs[:none].max(1)
        worth = np.flatnonzero((hope > pairs[:, none].min() + pairs[none].min()).any(1))
        if not len(worth):
            return []
        first, scores = np.array([spans[i][0] for i in worth.tolist()]), scores[worth]
        ending: dict[int, list[int]] = {}
        for i, j in enumerate(worth.tolist()):
            ending.setdefault(spans[j][1], []).append(i)
        spans = [spans[j] for j in worth.tolist()]
        value = np.full((n + 1, none + 1), -np.inf)  # best score up to a token, by the last label
        value[0, none] = 0.0
        back = [[(-1, none)] * (none + 1) for _ in range(n + 1)]  # the segment (-1: a token without one) and the label before it
        for t in range(1, n + 1):
            before = value[t - 1] + pairs[:, none]
            y = int(before.argmax())
            value[t, none], back[t][none] = before[y], (-1, y)
            if t in ending:
                at = np.array(ending[t])
                into = value[first[at]][:, :, None] + pairs[None, :, :none]
                total = into.max(1) + scores[at]
                best = total.argmax(0)
                value[t, :none] = total[best, np.arange(none)]
                for k, i in enumerate(best.tolist()):
                    back[t][k] = (int(at[i]), int(into[i, :, k].argmax()))
        out, t = [], n
        y = none if value[n, none] >= value[n].max() else int(value[n].argmax())
        while t > 0:
            i, before = back[t][y]
            if i >= 0:
                out.append((*spans[i], KINDS[y]))
            t, y = spans[i][0] if i >= 0 else t - 1, before
        return out[::-1]

    def expected(self, scores: np.ndarray, spans: list[tuple[int, int]], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of each labelled segment, and the expected number of each pair of labels, by the segment forward-backward recursions."""
        none = len(KINDS)
        first, stop = np.array(spans).T
        ends, starts = ([np.flatnonzero(x == t) for t in range(n + 1)] for x in (stop, first))
        pair, segment = np.exp(self.pairs), np.exp(scores)  # sentences are short: no sum leaves the range of doubles
        forward, backward = np.zeros((n + 1, none + 1)), np.ones((n + 1, none + 1))
        forward[0, none] = 1.0
        for t in range(1, n + 1):
            forward[t, none] = forward[t - 1] @ pair[:, none]
            if len(i := ends[t]):
                forward[t, :none] = (forward[first[i]] @ pair[:, :none] * segment[i]).sum(0)
        for t in range(n - 1, -1, -1):
            backward[t] = pair[:, none] * backward[t + 1, none]
            if len(i := starts[t]):
                backward[t] += pair[:, :none] @ (segment[i] * backward[stop[i], :none]).sum(0)
        whole = forward[n].sum()
        joint = forward[first][:, :, None] * pair[None, :, :none] * (segment * backward[stop, :none])[:, None, :] / whole
        pairs = np.zeros_like(self.pairs)
        pairs[:, :none] = joint.sum(0)
        pairs[:, none] = (forward[:-1] * backward[1:, none][:, None]).sum(0) * pair[:, none] / whole
        return joint.sum(1), pairs

    def step(self, words: list[str], gold: list[tuple[int, int, str]], rate: float) -> None:
        """One gradient step on log p(gold | words): observed minus expected features and pairs."""
        spans = candidates(words)
        if not spans:
            return
        scores, rows = self.score(words, spans, grow=True)
        chance, pairs = self.expected(scores, spans, len(words))
        right = {(a, b): KINDS.index(k) for a, b, k in gold}
        for i, span in enumerate(spans):
            slope = -chance[i]
            if (k := right.get(span)) is not None:
                slope[k] += 1
            if np.abs(slope).max() > 1e-4:
                np.add.at(self.weights, rows[i], rate * slope)
        last, at = len(KINDS), 0
        for a, b, k in sorted(gold):
            for y in [len(KINDS)] * (a - at) + [KINDS.index(k)]:
                pairs[last, y] -= 1
                last = y
            at = b
        for y in [len(KINDS)] * (len(words) - at):
            pairs[last, y] -= 1
            last = y
        self.pairs -= rate * pairs
        self.pairs[-1, -1] = 0.0


def example(rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A generated sentence and its entities as (start, end, kind) in characters."""
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "la", "que", "sch"]) for _ in range(rng.randint(1, 4)))
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card() -> str:
        d = rng.choice("3456") + number(rng.choice([13, 14, 14, 14]))
        return d + next(c for c in "0123456789" if luhn(d + c))

    def entity(kind: str) -> str:
        if kind == "email":
            at, dot = rng.choice([(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", " (dot) "), (" [at] ", "."), (" @ ", "."), ("@", "."), (" at ", ".")])
            return rng.choice([word(), word() + "." + word(), word() + number(2)]) + at + word() + dot + rng.choice(["com", "org", "net", "example" + dot + "com"])
        if kind == "ip":
            return ".".join(str(rng.randint(0, 255)) for _ in range(4))
        if kind == "card":
            d, sep = card(), rng.choice(["", " ", "-", " - ", "."])
            return sep.join(d[i : i + 4] for i in range(0, len(d), 4))
        a, b, c = number(3), number(3), number(4)
        return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}){b}-{c}", f"1-{a}-{b}-{c}", f"00{number(2)} {a} {b}{c}", f"+{number(1)} ({a}) {b}-{c}", f"{a} {b} {c}"])

    parts, gold, size = [], [], 0

    def add(s: str, kind: str | None = None) -> None:
        nonlocal size
        if kind:
            gold.append((size, size + len(s), kind))
        parts.append(s)
        size += len(s)

    for _ in range(rng.randint(1, 3)):
        for _ in range(rng.randint(1, 6)):
            add(word() + rng.choice(["", "", "", ",", "."]) + " ")
        kind = rng.choice([*KINDS, *KINDS, None, None, None])
        if kind:
            if rng.random() < 0.4:
                add(rng.choice(sorted(CUES[kind])) + rng.choice([" ", ": "]))
            add(entity(kind), kind)
        else:  # what only looks like an entity
            year = lambda: f"{rng.choice(['19', '20'])}{number(2)}"
            add(rng.choice([
                lambda: number(rng.randint(5, 11)), lambda: f"{year()}-{number(2)}-{number(2)}", lambda: f"{number(2)}.{number(2)}.{year()}", lambda: f"{number(1)}.{number(1)}.{number(2)}",
                lambda: number(16)[:-1] + "x", lambda: f"{number(3)},{number(3)},{number(3)}", lambda: word() + " at " + word() + ". " + word() + " dot " + word(), lambda: word() + " at " + word() + ".", lambda: f"{year()}-{year()}",
                lambda: f"{number(8)}-{number(4)}", lambda: f"{number(4)} {number(4)}", lambda: f"{number(2)}:{number(2)}:{number(2)}.{number(4)}", lambda: number(rng.randint(12, 24)),
                lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)), lambda: f"at {number(2)}. {word()} {number(9)}", lambda: f"{number(6)} {number(2)} {number(5)}",
            ])())
        add(rng.choice([" ", ". ", ", "]))
    return "".join(parts), gold


def train(examples: int = 900, epochs: int = 2, rate: float = 0.15, seed: int = 7) -> Model:
    rng, model = random.Random(seed), Model()
    data = [example(rng) for _ in range(examples)]
    for epoch in range(epochs):
        for text, gold in data:
            tokens = tokens_of(text)
            first, last = {a: i for i, (_, a, _) in enumerate(tokens)}, {b: i + 1 for i, (_, _, b) in enumerate(tokens)}
            model.step([w for w, _, _ in tokens], [(first[a], last[b], k) for a, b, k in gold if a in first and b in last], rate / (1 + epoch))
    return model


@lru_cache(maxsize=1)
def shared_model() -> Model:
    """The trained model; a driver trains it once and sends its few hundred weights with the tasks."""
    return train()


def triggers(text: str) -> list[tuple[int, int]]:
    """Parts that every entity holds one of: at-words, and digit runs that together have ``LEAST_DIGITS`` digits within ``MOST_TOKENS`` tokens."""
    found = [m.span() for m in AT.finditer(text)]
    runs = [m.span() for m in DIGITS.finditer(text)]
    near = 0  # runs[near:i + 1] may be in one segment
    held = tokens = 0  # their digits, and the tokens from the first to the last
    widths: list[int] = []
    for i, (a, b) in enumerate(runs):
        if i > near:
            end = runs[i - 1][1]
            # blanks alone show most gaps to be too wide
            blanks = text.count(" ", end, a)
            gap = MOST_TOKENS + 1 if blanks > MOST_TOKENS else sum(1 for _ in TOKEN.finditer(text, end, a))
            if gap > MOST_TOKENS or BREAK.search(text, end, a):
                near, held, tokens, widths = i, 0, 0, []
            else:
                widths.append(gap)
                tokens += gap
        held += b - a
        tokens += 1
        while tokens > MOST_TOKENS:
            held -= runs[near][1] - runs[near][0]
            tokens -= 1 + widths.pop(0)
            near += 1
        if held >= LEAST_DIGITS:
            found.append((runs[near][0], b))
    return sorted(found)


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of the text around triggers, wide enough for the longest entity and its context; overlapping parts are joined."""
    found = triggers(text)
    if not found:
        return []
    mirror, n = text[::-1], len(text)  # tokens are the same backwards
    out: list[list[int]] = []
    for a, b in found:
        start, stop = a, b
        for k, m in enumerate(TOKEN.finditer(mirror, n - a)):
            start = n - m.end()
            if k > MOST_TOKENS + TOKENS_BEFORE:
                break
        for k, m in enumerate(TOKEN.finditer(text, b)):
            stop = m.end()
            if k > MOST_TOKENS + TOKENS_BEHIND:
                break
        if out and start <= out[-1][1]:
            out[-1][1] = max(stop, out[-1][1])
        else:
            out.append([start, stop])
    return [tuple(x) for x in out]


def model_spans(text: str, taken: list[tuple[int, int]], model: Model | None = None) -> list[tuple[str, int, int]]:
    """Entities of the model outside the spans already taken."""
    model = model or shared_model()
    out = []
    taken = sorted(taken)
    for a, b in stretches(text):
        held = [(s - a, e - a) for s, e in taken if s < b and e > a]
        part = text[a:b]
        hidden = list(part)
        for s, e in held:
            hidden[max(0, s) : max(0, e)] = "\n" * (min(e, len(part)) - max(0, s))
        rest = "".join(hidden)
        if not triggers(rest):
            continue
        tokens = tokens_of(rest)
        words = [w for w, _, _ in tokens]
        for i, j, kind in model.decode(words):
            out.append((kind, a + tokens[i][1], a + tokens[j - 1][2]))
    return out


def find(text: str | None, model: Model | None = None) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """Base spans by kind, and all spans as (kind, start, end) by start, then kind as listed in ``KINDS``."""
    base = base_spans(text)
    spans = [(k, a, b) for k in KINDS for a, b in base[k]]
    if text:
        spans += model_spans(text, [(a, b) for _, a, b in spans], model)
    return base, sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each stretch of overlapping spans replaced by <KIND> of its first span."""
    if not text or not spans:
        return text
    out, end = [], 0
    for kind, a, b in spans:
        if a >= end:
            out += [text[end:a], f"<{kind.upper()}>"]
        end = max(end, b)
    return "".join(out) + text[end:]


def find_spans(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", with_text: bool = True) -> DataFrame:
    """Per row: the ``keep`` columns, counts of base spans, ``base`` and ``spans`` as joined text and, with ``with_text``, the redacted text."""

    refuse_names(keep, {*(f"n_{k}" for k in KINDS), "base_sha256", "base", "spans", "redacted"})
    model = shared_model()

    def work(*columns: list) -> dict:
        found = [find(t, model) for t in columns[-1]]
        base = [sorted(((k, a, b) for k in KINDS for a, b in f[0][k]), key=lambda s: (s[1], KINDS.index(s[0]))) for f in found]
        out = dict(zip(keep, columns)) | {f"n_{k}": [len(f[0][k]) for f in found] for k in KINDS}
        out |= {"base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b in base], "base": [joined(b) for b in base], "spans": [joined(f[1]) for f in found]}
        if with_text:
            out["redacted"] = [redact(t, f[1]) for t, f in zip(columns[-1], found)]
        return out

    kept = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    schema = ", ".join([*kept, *(f"n_{k} bigint" for k in KINDS), "base_sha256 string, base string, spans string"] + ["redacted string"] * with_text)
    return map_rows(df, [*keep, text], work, schema)
