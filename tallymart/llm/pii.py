"""Personal data: patterns, and a character-level bidirectional LSTM with a CRF on top, trained in numpy.

The patterns give the labelled spans. Windows of characters around them, and around other digits, at-signs and spelled-out dots, train the
tagger (embedding, one LSTM in each direction, emissions, transitions between tags). They are drawn for each kind apart, so a rare
kind is learned however large the corpus. Its gates are hard sigmoids and its values are squashed by roots, since exponentials were most
of the time of reading. A cell takes in as much as it forgets (coupled gates), so texts may be read in windows longer than those of the
training. What the tagger adds are spellings that no pattern matches: addresses with words or brackets
for their signs, groups parted in other ways, phone numbers without plus. Such spellings are written into the windows that it learns
from. It reads every text whole, in overlapping windows. A character's tag comes from
the window in which it lies deepest; spans are then read off the whole text, across windows. A span of the tagger counts
where no pattern span lies, where its mean tag probability is high, and if its digits or parts can be of that kind (check digits,
numbers up to 255, 8 to 15 digits, a name and a host).

Edge cases: null and empty texts have no spans. Without any labelled span the patterns alone decide. Repeated rows are
judged one by one; texts of any length are read whole. Offsets are code points, ends are exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallymart.llm.common import slices, strings

KINDS = ["email", "ip", "card", "phone"]
#: Windows that the tagger is trained on, at most: distinct ones, by hash order, a share for each kind and for windows without spans.
MAX_WINDOWS = 4_000
WINDOW, STRIDE = 80, 40
#: Characters that the tagger reads at once: of these lengths, that in which a text has least to be read twice. Neighbours share STRIDE of them.
LENGTHS = [WINDOW, 240, 400, 560, 720]
READ = LENGTHS[-1]
#: Windows read side by side, and those multiplied at once: few enough for the direct way of the BLAS, and no power of two, since rows would then
#: share their places in the cache.
BATCH, PART = 656, 328
#: Characters around a digit or at-sign that belong to its surroundings.
CONTEXT, GAP = 24, 40
CONFIDENCE = 0.95
EMBEDDING, HIDDEN = 12, 20
TAGS = 1 + 2 * len(KINDS)
SYMBOLS = 130

Span = tuple[str, int, int]

#: A digit, an at-sign, "dot" between other characters than letters, "at" in brackets. What a match can begin with stands first, since
#: the search then leaps to it; the four letters beside ASCII are those that differ from one of its letters in case alone.
_ANCHOR = re.compile(
    r"[0-9@DdAa](?:(?<=[0-9@])|(?<=[Dd])(?<![A-Za-z\u0130\u0131\u017f\u212a].)[Oo][Tt](?![A-Za-z\u0130\u0131\u017f\u212a])"
    r"|(?<=[\[({<][Aa])[Tt](?=[\])}>]))",
    re.DOTALL,
)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# A match fails or ends with the whole run of digits it begins in, so only beginnings of runs need a try.
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", last)


def pattern_spans(text: str) -> list[Span]:
    """What the fixed patterns find, by kind and start."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        first = text[m.start() : m.start(1) - 1]
        if all(int(x[-4:]) <= 255 and not x[:-4].strip("0") for x in (first, *m.groups())):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", m[0]) if m.end() - m.start() < 80 else ""
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def surroundings(text: str) -> list[tuple[int, int]]:
    """Disjoint stretches around digits and at-signs."""
    at = np.array([m.start() for m in _ANCHOR.finditer(text)], np.int64)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > GAP)
    first, last = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
    return [(max(0, a - CONTEXT), min(len(text), b + 1 + CONTEXT)) for a, b in zip(first.tolist(), last.tolist())]


def anchored(text: str) -> list[tuple[int, int]]:
    """Overlapping windows over the surroundings, which the training windows are drawn from."""
    out = []
    for a, b in surroundings(text):
        starts = range(a, max(a + 1, b - WINDOW + STRIDE), STRIDE)
        out += [(s, min(s + WINDOW, b)) for s in starts]
    return out


def windows(size: int) -> list[tuple[int, int]]:
    """Overlapping windows over a whole text of a size, all of one of LENGTHS; a text shorter than each is one window."""

    def starts(length: int) -> range:
        return range(0, max(1, size - STRIDE), length - STRIDE)

    length = min((x for x in LENGTHS if x <= size), key=lambda x: (x * len(starts(x)), -x), default=WINDOW)
    # The last window of a long text is whole, too.
    return [(min(s, max(0, size - length)), min(s + length, size)) for s in starts(length)] if size else []


#: Characters that read alike: brackets, and what people part groups of digits with.
_ALIKE = str.maketrans({**dict.fromkeys("[{<", "("), **dict.fromkeys("]}>", ")"), **dict.fromkeys("_|~=*#\\^;:", "/")})


def encode(texts: list[str]) -> np.ndarray:
    """Symbol numbers: 0 beyond the end, ASCII as it is but for characters that read alike, one number each for other letters and
    other characters."""
    out = np.zeros((len(texts), WINDOW), np.int64)
    for k, t in enumerate(texts):
        out[k, : len(t)] = [c if (c := ord(x)) < 128 else 128 + (not x.isalpha()) for x in t.translate(_ALIKE)]
    return out


#: Symbol of each ASCII character.
_SYMBOL = np.array([ord(chr(c).translate(_ALIKE)) for c in range(128)], np.uint8)


def symbols_of(text: str) -> np.ndarray:
    """The numbers that :func:`encode` gives to the characters of a text."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = _SYMBOL[np.minimum(code, 127)]
    far = np.flatnonzero(code > 127)
    if len(far):
        kinds, which = np.unique(code[far], return_inverse=True)
        out[far] = np.array([128 + (not chr(c).isalpha()) for c in kinds.tolist()], np.uint8)[which]
    return out


def tags_of(spans: list[Span], start: int, end: int) -> np.ndarray:
    """Tags of a window: 0, or 2k+1 for the first character of kind k and 2k+2 for the rest."""
    out = np.zeros(WINDOW, np.int64)
    for kind, a, b in spans:
        if a < end and b > start:
            k = KINDS.index(kind)
            out[max(a, start) - start : min(b, end) - start] = 2 * k + 2
            if a >= start:
                out[a - start] = 2 * k + 1
    return out


def _gate(x: np.ndarray) -> np.ndarray:
    """Hard sigmoid, which takes no exponential."""
    return np.clip(0.25 * x + 0.5, 0, 1)


def _gate_slope(y: np.ndarray) -> np.ndarray:
    return 0.25 * ((y > 0) & (y < 1))


def _squash(x: np.ndarray) -> np.ndarray:
    """Between -1 and 1, like a hyperbolic tangent but of plain arithmetic."""
    return x / np.sqrt(1 + x * x)


def _squash_slope(y: np.ndarray) -> np.ndarray:
    rest = np.maximum(1 - y * y, 0)
    return rest * np.sqrt(rest)


class Lstm:
    """One direction; arrays are (time, batch, values). A cell takes in what it forgets, so it stays between -1 and 1 however long the text."""

    @staticmethod
    def forward(x: np.ndarray, w: np.ndarray, b: np.ndarray):
        t, n, d = x.shape
        h_size = w.shape[1] // 3
        pre = (x.reshape(-1, d) @ w[:d]).reshape(t, n, -1) + b
        h, c = np.zeros((t + 1, n, h_size), x.dtype), np.zeros((t + 1, n, h_size), x.dtype)
        gates = np.empty((t, n, 3 * h_size), x.dtype)
        recurrent = w[d:]
        for k in range(t):
            z = pre[k] + h[k] @ recurrent
            z[:, : 2 * h_size] = _gate(z[:, : 2 * h_size])
            z[:, 2 * h_size :] = _squash(z[:, 2 * h_size :])
            gates[k] = z
            f, o, g = np.split(z, 3, 1)
            c[k + 1] = g + f * (c[k] - g)
            h[k + 1] = o * c[k + 1]
        return h, c, gates

    @staticmethod
    def backward(x, w, state, dh_out):
        h, c, gates = state
        t, n, d = x.shape
        h_size = w.shape[1] // 3
        dz = np.empty_like(gates)
        dh, dc = np.zeros((n, h_size), x.dtype), np.zeros((n, h_size), x.dtype)
        for k in reversed(range(t)):
            f, o, g = np.split(gates[k], 3, 1)
            dh = dh + dh_out[k]
            dc = dc + dh * o
            own = _gate_slope(gates[k, :, : 2 * h_size])
            dz[k] = np.concatenate([dc * (c[k] - g), dh * c[k + 1], dc * (1 - f) * _squash_slope(g)], 1)
            dz[k, :, : 2 * h_size] *= own
            dc = dc * f
            dh = dz[k] @ w[d:].T
        flat = dz.reshape(-1, 3 * h_size)
        dw = np.concatenate([x.reshape(-1, d).T @ flat, h[:-1].reshape(-1, h_size).T @ flat])
        return (flat @ w[:d].T).reshape(x.shape), dw, flat.sum(0)


class Tagger:
    def __init__(self, seed: int = 0, dtype=np.float32):
        r = np.random.default_rng(seed)

        def normal(*shape):
            return (r.normal(0, 1, shape) * 0.3).astype(dtype)

        self.p = {
            "e": normal(SYMBOLS, EMBEDDING), "fw": normal(EMBEDDING + HIDDEN, 3 * HIDDEN), "fb": np.zeros(3 * HIDDEN, dtype),
            "bw": normal(EMBEDDING + HIDDEN, 3 * HIDDEN), "bb": np.zeros(3 * HIDDEN, dtype),
            "u": normal(2 * HIDDEN, TAGS), "c": np.zeros(TAGS, dtype), "a": normal(TAGS, TAGS), "s": normal(TAGS),
        }

    def emissions(self, symbols: np.ndarray):
        p = self.p
        x = p["e"][symbols.T]
        forward = Lstm.forward(x, p["fw"], p["fb"])
        backward = Lstm.forward(x[::-1], p["bw"], p["bb"])
        both = np.concatenate([forward[0][1:], backward[0][1:][::-1]], 2)
        return both @ p["u"] + p["c"], (x, forward, backward, both)

    def posteriors(self, e: np.ndarray):
        """Tag probabilities (time, batch, tags), log-likelihood of the best scale, and what pairs of tags expect."""
        t, n, k = e.shape
        move = np.exp(self.p["a"])
        top = e.max(2, keepdims=True)
        lit = np.exp(e - top)
        alpha, beta = np.empty_like(e), np.ones_like(e)
        scale = np.empty((t, n, 1), e.dtype)
        now = np.exp(self.p["s"]) * lit[0]
        for j in range(t):
            if j:
                now = (alpha[j - 1] @ move) * lit[j]
            scale[j] = now.sum(1, keepdims=True)
            alpha[j] = now / scale[j]
        for j in reversed(range(t - 1)):
            beta[j] = (lit[j + 1] * beta[j + 1]) @ move.T / scale[j + 1]
        pairs = np.einsum("tni,tnj->ij", alpha[:-1], lit[1:] * beta[1:] / scale[1:]) * move
        return alpha * beta, (np.log(scale) + top).sum(), pairs

    def step(self, symbols: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log-likelihood of the tags per window, and its gradients."""
        p, n = self.p, len(symbols)
        e, (x, forward, backward, both) = self.emissions(symbols)
        q, log_z, pairs = self.posteriors(e)
        y = tags.T
        truth = np.zeros_like(q)
        np.put_along_axis(truth, y[..., None], 1, 2)
        seen = np.zeros_like(p["a"])
        np.add.at(seen, (y[:-1].ravel(), y[1:].ravel()), 1)
        loss = log_z - (e * truth).sum() - (p["a"] * seen).sum() - p["s"][y[0]].sum()
        de = (q - truth) / n
        flat = de.reshape(-1, TAGS)
        d_both = de @ p["u"].T
        dx, dfw, dfb = Lstm.backward(x, p["fw"], forward, d_both[..., :HIDDEN])
        dx2, dbw, dbb = Lstm.backward(x[::-1], p["bw"], backward, d_both[::-1, :, HIDDEN:])
        d_e = np.zeros_like(p["e"])
        np.add.at(d_e, symbols.T, dx + dx2[::-1])
        return float(loss) / n, {
            "e": d_e, "fw": dfw, "fb": dfb, "bw": dbw, "bb": dbb, "u": both.reshape(-1, 2 * HIDDEN).T @ flat, "c": flat.sum(0),
            "a": (pairs - seen) / n, "s": de[0].sum(0),
        }

    def decode(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tag path of each window (batch, time) and the probability of each of its tags."""
        return self.paths(self.read(symbols).transpose(1, 2, 0))

    def paths(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`decode` of emissions (time, batch, tags); without a tag, a path's probabilities are left at zero."""
        path = self.best_path(e)
        tagged = path.any(0)
        sure = np.zeros(path.shape, e.dtype)
        q, _, _ = self.posteriors(e[:, tagged])
        sure[:, tagged] = np.take_along_axis(q, path[:, tagged, None], 2)[..., 0]
        return path.T, sure.T

    def maybe_tagged(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and emissions of the windows whose best path may have a tag; that of the others has none."""
        e, lead = self._read(symbols)
        a, s = self.p["a"], self.p["s"]
        stay, into, out_of, begin = a[1:, 1:].max(), a[0, 1:].max(), a[1:, 0].max(), s[1:].max() - s[0]
        # A tagged stretch gains at most (lead + step) a character and what its ends bring. Where no character gains that much, the path
        # without tags is best.
        step = stay - a[0, 0]
        ends = max(into + out_of - stay - a[0, 0], begin + out_of - stay, into - stay, begin - stay + a[0, 0], 0)
        gain = lead + step
        some = np.flatnonzero(gain.max(0) + ends >= -1e-3)
        gain = gain[:, some]
        # What the best stretches that end and begin at a character gain; one through it gains both.
        through, back = gain.copy(), gain.copy()
        for j in range(1, len(gain)):
            through[j] += np.maximum(through[j - 1], 0)
            back[-1 - j] += np.maximum(back[-j], 0)
        through += back
        through -= gain
        some = self._tagged_stretches(e, some, through >= -1e-2 - ends)
        return some, e[:, :, some].transpose(1, 2, 0)

    def _tagged_stretches(self, e: np.ndarray, some: np.ndarray, open_: np.ndarray) -> np.ndarray:
        """Numbers of those of some windows whose best path may have a tag. Characters that are not open have none, so each open stretch has a
        best path of its own; one that reaches its window's edge counts as tagged."""
        edges = np.diff(open_.T.astype(np.int8), axis=1, prepend=0, append=0)
        (window, first), end = np.nonzero(edges > 0), np.nonzero(edges < 0)[1]
        window = some[window]
        kept = (first == 0) | (end == len(open_))
        found = [window[kept]]
        order = np.flatnonzero(~kept)
        order = order[np.argsort(end[order] - first[order], kind="stable")]
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            # Between the untagged characters beside it.
            place = np.arange(-1, (end[part] - first[part]).max() + 1)[:, None] + first[part]
            shut = (place < first[part]) | (place >= end[part])
            mine = e[:, np.minimum(place, len(open_) - 1), window[part]]
            mine[1:, shut] = -1e9
            found.append(window[part][self.best_path(mine.transpose(1, 2, 0)).any(0)])
        return np.unique(np.concatenate(found))

    def read(self, symbols: np.ndarray) -> np.ndarray:
        """Emissions (tags, time, batch), without what training needs."""
        return self._read(symbols)[0]

    def _read(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`read`, and by how much the best tag leads over none (time, batch). Both directions go through their steps side by side."""
        p, (n, t) = self.p, symbols.shape
        kind = p["c"].dtype
        # Windows are multiplied PART at a time and squashed together.
        parts = max(1, -(-n // PART))
        wide = -(-n // parts)
        all_ = parts * wide
        # The line of the hard sigmoid is part of the weights, so that only its ends are left to cut.
        line, lift = (np.repeat(np.array([v, v, last], kind), HIDDEN) for v, last in ((0.25, 1), (0.5, 0)))
        weights = np.stack([
            np.concatenate([w[EMBEDDING:] * line, [b * line + lift], w[:EMBEDDING] * line]).T
            for w, b in ((p["fw"], p["fb"]), (p["bw"], p["bb"]))
        ])
        u = np.zeros((2, TAGS, HIDDEN + 1), kind)
        u[:, :, :-1], u[0, :, -1] = p["u"].reshape(2, HIDDEN, TAGS).transpose(0, 2, 1), p["c"]
        weights, u, embedded = np.repeat(weights, parts, 0), np.repeat(u, parts, 0), np.ascontiguousarray(p["e"].T)
        both = np.zeros((t, 2 * all_), np.intp)
        both[:, :n] = symbols.T
        both[:, all_ : all_ + n] = symbols.T[::-1]
        # What a step reads lies together: the values before it, a one, and its embedded symbol; columns are windows, once for each direction.
        read = np.zeros((HIDDEN + 1 + EMBEDDING, 2 * all_), kind)
        read[HIDDEN] = 1
        h, given = read[:HIDDEN], read[HIDDEN + 1 :]
        z, c, r = np.empty((3 * HIDDEN, 2 * all_), kind), np.zeros_like(h), np.empty_like(h)
        gates, (f, o, g) = z[: 2 * HIDDEN], z.reshape(3, HIDDEN, 2 * all_)
        read_, z_ = (x.reshape(len(x), 2 * parts, wide).transpose(1, 0, 2) for x in (read, z))
        h_ = read_[:, : HIDDEN + 1]
        ahead, behind = slice(0, parts), slice(parts, None)
        out, lead = np.empty((t, TAGS, all_), kind), np.empty((t, all_), kind)
        other = np.empty((TAGS, 2 * all_), kind)
        out_ = out.reshape(t, TAGS, parts, wide).transpose(0, 2, 1, 3)
        other_ = other.reshape(TAGS, 2 * parts, wide).transpose(1, 0, 2)
        for k in range(t):
            embedded.take(both[k], 1, given, "clip")
            np.matmul(weights, read_, z_)
            gates.clip(0, 1, gates)
            # Squashed.
            np.multiply(g, g, r)
            np.add(r, 1, r)
            np.sqrt(r, r)
            np.divide(g, r, g)
            np.subtract(c, g, c)
            np.multiply(c, f, c)
            np.add(c, g, c)
            np.multiply(c, o, h)
            # Half-way the directions meet; from there on each comes to characters that the other has been at.
            j = t - 1 - k
            if k < j:
                np.matmul(u[ahead], h_[ahead], out_[k])
                np.matmul(u[behind], h_[behind], out_[j])
                continue
            np.matmul(u, h_, other_)
            if k == j:
                np.add(other[:, :all_], other[:, all_:], out[k])
            else:
                np.add(out[k], other[:, :all_], out[k])
                np.add(out[j], other[:, all_:], out[j])
                np.max(out[j, 1:], axis=0, out=lead[j])
            np.max(out[k, 1:], axis=0, out=lead[k])
        lead -= out[:, 0]
        return out[:, :, :n].transpose(1, 0, 2), lead[:, :n]

    def best_path(self, e: np.ndarray) -> np.ndarray:
        t, n, k = e.shape
        # Windows lie side by side, and only the worth of the best ways is kept; the tag before is sought again on the way back, for one tag each.
        e, move = np.ascontiguousarray(e.transpose(0, 2, 1)), self.p["a"][:, :, None]
        best, step = np.empty_like(e), np.empty((k, k, n), e.dtype)
        best[0] = self.p["s"][:, None] + e[0]
        for j in range(1, t):
            np.add(best[j - 1][:, None], move, out=step)
            np.max(step, axis=0, out=best[j])
            best[j] += e[j]
        path = np.empty((t, n), np.int64)
        path[-1] = best[-1].argmax(0)
        into = np.ascontiguousarray(self.p["a"].T)
        for j in reversed(range(1, t)):
            path[j - 1] = (best[j - 1].T + into[path[j]]).argmax(1)
        return path


_NAMES = "anna.berg j.smith info sales luca_rossi m.dupont office pat42 k.meyer support team hello dr.wu".split()
_HOSTS = "example mail post web-shop uni-nord acme firma office24 data-lab northwind".split()
_ENDS = "com org net de fr es io co.uk".split()
#: What parts the groups of written numbers.
_SEPARATORS = [".", "/", "  ", " / ", " . ", " - ", ","]
_AROUND = [("[", "]"), ("(", ")"), (" [", "] "), (" (", ") "), (" ", " ")]


def _check_digit(digits: str) -> str:
    return next(d for d in "0123456789" if _luhn(digits + d))


def spelled(kind: str, r: np.random.Generator) -> str:
    """A value of a kind in a spelling that no pattern matches."""
    pick = lambda options: options[r.integers(len(options))]
    number = lambda n: "".join(map(str, r.integers(0, 10, n)))
    if kind == "email":
        (a, b), (c, d) = pick(_AROUND), pick(_AROUND)
        at, dot = pick(["at", "at", "AT"]), pick(["dot", "dot", "DOT"])
        name, host, end = pick(_NAMES), pick(_HOSTS), pick(_ENDS)
        if r.random() < 0.2:
            return f"{name}{pick([' @ ', '@ ', ' @'])}{host}.{end}"
        return f"{name}{a}{at}{b}{host}{c}{dot}{d}{end}"
    if kind == "ip":
        return pick(["[.]", "(.)", " . ", ",", "-", " dot ", "[dot]", ". ", "/", " / "]).join(str(x) for x in r.integers(1, 256, 4))
    if kind == "card":
        digits = pick(["4", "5", "37"]) + number(15)
        digits = digits[:15] + _check_digit(digits[:15])
        return pick(_SEPARATORS).join(digits[k : k + 4] for k in range(0, 16, 4))
    area, mid, last = number(3), number(3), number(4)
    forms = [
        f"({area}) {mid}-{last}", f"{area}-{mid}-{last}", f"{area}.{mid}.{last}", f"{area} {mid} {last}", f"00{number(2)} {area} {mid}{last}",
        f"0{number(3)}/{mid}{last}", f"0{number(2)}-{mid}{last}", f"00{number(2)}-{area}-{mid}-{last}", f"{area}/{mid}-{last}",
    ]
    return pick(forms)


def written_into(text: str, spans: list[Span], r: np.random.Generator, spell=spelled) -> tuple[str, list[Span]]:
    """A window whose spans are spelled otherwise, or which gets a value between two of its words if it holds none."""
    out, made, last = "", [], 0
    if not spans:
        gaps = [m.end() for m in re.finditer(" ", text[: WINDOW - 24])]
        if not gaps or _ANCHOR.search(text):
            return text, []
        at = gaps[r.integers(len(gaps))]
        spans = [(KINDS[r.integers(len(KINDS))], at, at)]
        text = f"{text[:at]} {text[at:]}"
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a < last:
            continue
        out += text[last:a]
        value = spell(kind, r)
        made.append((kind, len(out), len(out) + len(value)))
        out += value
        last = b
    out += text[last:]
    # What the end cuts off is no whole value.
    return out[:WINDOW], [(k, a, min(b, WINDOW)) for k, a, b in made if a < WINDOW]


def train(rows: list[tuple[str, list[Span]]], steps: int = 900, batch: int = 64, seed: int = 0) -> Tagger | None:
    """Learn from windows and the spans that lie in them."""
    if not any(spans for _, spans in rows):
        return None
    random = np.random.default_rng(seed)
    # Windows with spans as they are and spelled otherwise; windows without, as they are and (of prose only) with a value written in.
    rows = [(t[:WINDOW], s) for t, s in rows] + [w for t, s in rows for _ in range(2) if (w := written_into(t, s, random))[1]]
    symbols, tags = encode([t for t, _ in rows]), np.stack([tags_of(s, 0, WINDOW) for _, s in rows])
    model = Tagger(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(x) for k, x in model.p.items()}
    n = 0
    while n < steps:
        order = random.permutation(len(rows))
        for at in range(0, len(order), batch):
            pick, n = order[at : at + batch], min(n + 1, steps)
            rate = 0.02 * (1 - 0.9 * n / steps)
            _, grads = model.step(symbols[pick], tags[pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 5 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                model.p[k] -= (rate * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-8)).astype(g.dtype)
    return model


def tagged_spans(model: Tagger, texts: list[str], confidence: float = CONFIDENCE, batch: int = BATCH) -> list[list[Span]]:
    """Spans that the tagger finds in each text; windows of one text are reconciled over the whole of it."""
    symbols = [symbols_of(t) for t in texts]
    where = [(k, a, b) for k, t in enumerate(texts) for a, b in windows(len(t))]
    out: list[list[Span]] = [[] for _ in texts]
    found: dict[int, dict] = {}

    def settle(held: list) -> None:
        for (k, a, b), path, q in zip([w for w, _ in held], *model.paths(np.stack([e for _, e in held], 1))):
            if path.any():
                found.setdefault(k, {})[a, b] = path, q
        held.clear()

    for length in LENGTHS:
        mine = [w for w in where if max(w[2] - w[1], WINDOW) == length]
        held: list = []
        for at in range(0, len(mine), batch):
            part = mine[at : at + batch]
            read = np.zeros((len(part), length), np.uint8)
            for row, (k, a, b) in zip(read, part):
                row[: b - a] = symbols[k][a:b]
            some, e = model.maybe_tagged(read)
            held += [(part[n], e[:, k]) for k, n in enumerate(some.tolist())]
            if len(held) >= batch:
                settle(held)
        if held:
            settle(held)
    tags, sure = {}, {}
    for k, read in found.items():
        size = len(texts[k])
        tags[k], sure[k], deep = np.zeros(size, np.int8), np.zeros(size, np.float32), np.full(size, -1, np.int16)
        for a, b in windows(size):
            place = np.arange(b - a)
            inside = np.minimum(place + 1, b - a - place)
            # The beginning and the end of a text are no window's edge.
            inside = np.where((a == 0) & (place < STRIDE), READ, inside)
            better = inside > deep[a:b]
            path, q = read.get((a, b), (np.zeros(b - a, np.int64), np.zeros(b - a)))
            for stored_, new in ((tags[k], path), (sure[k], q), (deep, inside)):
                stored_[a:b][better] = new[: b - a][better]
    for k, row in tags.items():
        text = texts[k]
        kind = np.where(row > 0, (row + 1) // 2, 0)
        opens = (kind > 0) & ((row % 2 == 1) | (np.concatenate([[0], kind[:-1]]) != kind))
        for a in np.flatnonzero(opens).tolist():
            b = a + 1
            while b < len(row) and kind[b] == kind[a] and row[b] % 2 == 0:
                b += 1
            if sure[k][a:b].mean() >= confidence:
                out[k].append((KINDS[kind[a] - 1], a, b))
        out[k] = [s for s in out[k] if _plausible(text[s[1] : s[2]], s[0]) and not _cut(text, s[1], s[2])]
    return out


def _cut(text: str, a: int, b: int) -> bool:
    """Whether a span ends inside a word or number."""
    return (a > 0 and text[a - 1].isalnum() and text[a].isalnum()) or (b < len(text) and text[b].isalnum() and text[b - 1].isalnum())


def _plausible(value: str, kind: str) -> bool:
    """Whether a value can be of the kind, however it is spelled."""
    numbers = re.findall("[0-9]+", value)
    digits = "".join(numbers)
    if not value or value != value.strip() or "\n" in value:
        return False
    if kind == "email":
        parts = re.split(r"[^A-Za-z0-9._%+-]+", value)
        return len(parts) > 1 and ("@" in value or bool(re.search(r"(?i)\bat\b", value)) and bool(re.search(r"(?i)\bdot\b|\.", value)))
    if kind == "ip":
        return len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers)
    if kind == "card":
        return 13 <= len(digits) <= 19 and _luhn(digits)
    return 8 <= len(digits) <= 15 and not re.search("[A-Za-z]", value)


def find(texts: list[str], model: Tagger | None) -> list[tuple[list[Span], list[Span]]]:
    """For each text the pattern spans, and all spans; by kind as listed, then start."""
    base = [pattern_spans(t) for t in texts]
    extra = tagged_spans(model, texts) if model else [[] for _ in texts]
    out = []
    for known, more in zip(base, extra):
        more = [s for s in more if not any(s[1] < b and a < s[2] for _, a, b in known)]
        out.append((known, sorted(known + more, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def fit(docs: DataFrame, max_windows: int = MAX_WINDOWS) -> Tagger | None:
    """Train on at most ``max_windows`` distinct windows of the documents: an eighth for each kind, half without spans."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = set()
            for text in strings(batch):
                spans = pattern_spans(text)
                # Prose, too, for values to be written into; one window of a text.
                for a, b in [*anchored(text), (0, min(WINDOW, len(text)))]:
                    inside = [(k, s - a, e - a) for k, s, e in spans if s >= a and e <= b]
                    crossing = any(s < b and e > a and not (s >= a and e <= b) for _, s, e in spans)
                    if not crossing:
                        rows.add((text[a:b], joined(inside), inside[0][0] if inside else "none"))
            if rows:
                made = sorted(rows)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in made], pa.string()) for k in (0, 1, 2)], ["part", "spans", "kind"])

    order = Window.partitionBy("kind").orderBy(F.xxhash64("part"), "part", "spans")
    share = F.when(F.col("kind") == "none", max_windows // 2).otherwise(max_windows // (2 * len(KINDS)))
    found = docs.select("text").mapInArrow(cut, "part string, spans string, kind string").distinct().withColumn("nth", F.row_number().over(order))
    sample = found.where(F.col("nth") <= max_windows // 2).where(F.col("nth") <= share).orderBy("part", "spans").collect()
    rows = []
    for r in sample:
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        rows.append((r["part"], [(k, int(a), int(b)) for k, a, b in spans]))
    return train(rows)


def detect(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """doc_id, base_spans, spans (array of kind, start, end) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = find(strings(batch), model)
            columns = [
                pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in f[which]] for f in found], span) for which in (0, 1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "base_spans", "spans"])

    each = "array<struct<kind: string, start: long, end: long>>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, base_spans {each}, spans {each}")


def mask(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"<{kind.upper()}>"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def redact(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """All columns, with personal data masked in ``text`` and ``n_chars`` (where there is one) counted anew; null texts stay null."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            found = find([t or "" for t in texts], model)
            clean = [None if t is None else mask(t, f[1]) for t, f in zip(texts, found)]
            columns = {c: batch.column(c) for c in names}
            columns["text"] = pa.array(clean, batch.column("text").type)
            if "n_chars" in columns:
                old = columns["n_chars"]
                columns["n_chars"] = pa.array(
                    [o if c is None or c == t else len(c) for o, c, t in zip(old.to_pylist(), clean, texts)], old.type
                )
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return docs.mapInArrow(run, docs.schema)
