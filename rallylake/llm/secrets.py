"""Secret scan: base patterns, and formats inferred from labelled credentials.

Each format's labelled strings form a prefix tree over single characters (digits are one symbol). States
at the same depth whose outgoing frequencies are statistically compatible (Hoeffding bound) are merged,
so the probabilistic automaton keeps what a format says about prefixes, places and lengths; depth is
bounded by the longest labelled string, and what is longer stays in a last state. Every run of eight or
more token characters in every text, words and runs inside base matches included, is scored by its
likelihood under each format's automaton against the best of the ordinary models: characters after
characters and classes after classes, both over the table's own distinct runs and rule-made names, and
automata of ordinary formats (identifiers, dates), and patterns that repeat. Runs above the threshold that no base match overlaps are reported
beside the base matches; those inside are reported by their scores.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallylake.llm.common import arrow_map, materialize, per_batch, utf8

# The base patterns, kinds in their listed order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "inferred")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Candidates: runs of at least so many of these characters.
LEAST = 8
CHARACTERS = string.ascii_lowercase + string.ascii_uppercase + "+/_=-"
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{8,}")
#: Symbol 0 is the end of a run, 1 a digit; others are characters as they are.
SYMBOLS = len(CHARACTERS) + 2
CODE = np.zeros(256, np.uint8)
CODE[list(string.digits.encode())] = 1
CODE[list(CHARACTERS.encode())] = np.arange(2, SYMBOLS)
RUNS = bytes(c if CODE[c] else 32 for c in range(256))
#: Classes of symbols: the end, digits, lower case, upper case, and every other character for itself.
KIND = np.array([0, 1] + [2 if c.islower() else 3 if c.isupper() else 4 + k for k, c in enumerate(CHARACTERS)])
KIND[KIND > 4] -= 52
#: Characters a symbol stands for.
WIDTH = np.where(np.arange(SYMBOLS) == 1, 10, 1)


def labelled_credentials(per_format: int = 400, seed: int = 7) -> list[tuple[str, str]]:
    """(credential, format) made by rule from public formats; formats named "word" hold ordinary names, and
    those that begin with "word-" other ordinary strings."""
    r = random.Random(seed)
    lower, upper, digits, hexa = string.ascii_lowercase, string.ascii_uppercase, string.digits, "0123456789abcdef"
    of = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    alnum = string.ascii_letters + digits
    prefix = lambda: r.choice(("ghp_", "gho_", "glpat-", "sk_live_", "pk_live_", "xoxb-", of(lower, r.randint(2, 6)) + r.choice("_-")))
    syllable = lambda: of("bcdfghlmnprstvw", 1) + of("aeiou", 1) + of("lmnrst", r.randint(0, 1))
    word = lambda: "".join(syllable() for _ in range(r.randint(1, 4)))
    rules = {
        "hex": lambda: of(hexa, r.choice((32, 40, 64))),
        "cloud_key": lambda: "AKIA" + of(upper + digits, 16),
        "prefixed": lambda: prefix() + of(alnum, r.choice((24, 36))),
        "prefixed_hex": lambda: prefix() + of(hexa, r.choice((32, 40, 64))),
        "base64": lambda: of(alnum + "+/", r.choice((40, 43, 44))) + r.choice(("", "=")),
        "alphanumeric": lambda: of(alnum, r.randint(12, 40)),
    }
    number = lambda: of(digits, r.choice((1, 1, 2, 2, 3, 4, 8)))
    part = lambda: r.choice((word, word, word, lambda: word() + number(), number, lambda: "v" + number(), lambda: word().upper()))()
    plain = (
        lambda: r.choice(("-", "_", "/", "/")).join(part() for _ in range(r.randint(2, 6))),
        lambda: "/".join("-".join(part() for _ in range(r.randint(1, 3))) for _ in range(r.randint(2, 6))),
        lambda: r.choice((str, str.title))(word()) + "".join(word().title() for _ in range(r.randint(1, 4))) + r.choice(("", number())),
        lambda: "_".join(word().upper() for _ in range(r.randint(1, 4))) + r.choice(("", "_" + number())),
        lambda: r.choice((str, str.title, str.upper))(word() + word()),
    )
    ordinary = {
        "word": lambda: r.choice(plain)(),
        "word-uuid": lambda: "-".join(of(hexa, n) for n in (8, 4, 4, 4, 12)),
        "word-digits": lambda: of(digits, r.randint(4, 30)),
        "word-date": lambda: f"{of(digits, 4)}-{of(digits, 2)}-{of(digits, 2)}" + r.choice(("", "T" + of(digits, 2))),
    }
    made = [(make(), name) for name, make in rules.items() for _ in range(per_format)]
    return made + [(make(), name) for name, make in ordinary.items() for _ in range(per_format * (10 if name == "word" else 1))]


def codes(text: str | bytes) -> np.ndarray:
    return CODE[np.frombuffer(text.encode("ascii", "replace") if isinstance(text, str) else text, np.uint8)]


class Automaton:
    """A probabilistic automaton merged from the prefix tree of ``strings`` (red and blue states, layer by
    layer). ``step[state, symbol]`` is the next state, ``log[state, symbol]`` the log-likelihood of the
    symbol (0: the string ends); the last state takes what is longer than every string."""

    def __init__(self, strings: list[str], alpha: float = 0.01, min_count: int = 8, unseen: float = 0.02):
        seen, ends, to, times = [0], [0], [{}], [{}]
        for x in strings:
            at = 0
            seen[0] += 1
            for c in codes(x).tolist():
                if c not in to[at]:
                    to[at][c] = len(seen)
                    seen.append(0)
                    ends.append(0)
                    to.append({})
                    times.append({})
                times[at][c] = times[at].get(c, 0) + 1
                at = to[at][c]
                seen[at] += 1
            ends[at] += 1
        self.alpha, self.min_count = alpha, min_count
        self.seen, self.ends, self.to, self.times = seen, ends, to, times
        layer, kept = [0], []
        while layer:
            red: list[int] = []
            into = {}
            for state in sorted(set(layer), key=lambda s: (-seen[s], s)):
                same = next((r for r in red if self._compatible(r, state)), None)
                if same is None:
                    red.append(state)
                else:
                    into[state] = same
                    self._fold(same, state)
            # arcs of the layer above lead to what was merged
            for r in kept[-1] if kept else ():
                to[r] = {c: into.get(s, s) for c, s in to[r].items()}
            kept.append(red)
            layer = [s for r in red for s in to[r].values()]
        states = [s for red in kept for s in red]
        number = {s: k for k, s in enumerate(states)}
        self.states, n = len(states), len(states)
        self.step = np.full((n + 1, SYMBOLS), n, np.int32)
        count = np.zeros((n + 1, SYMBOLS))
        for s in states:
            count[number[s], 0] = ends[s]
            for c, t in to[s].items():
                self.step[number[s], c], count[number[s], c] = number[t], times[s][c]
        count[n] = count[:n].sum(axis=0)
        # a symbol not seen in a state goes on as at the same depth: to the first state of the next layer
        for depth, red in enumerate(kept):
            for s in red:
                miss = [c for c in range(1, SYMBOLS) if c not in to[s]]
                self.step[number[s], miss] = number[kept[depth + 1][0]] if depth + 1 < len(kept) else n
        share = count / np.maximum(1, count.sum(axis=1, keepdims=True))
        flat = np.where(np.arange(SYMBOLS) == 0, 1, WIDTH) / (WIDTH[1:].sum() + 1)
        self.log = np.log((1 - unseen) * share + unseen * flat) - np.log(np.where(np.arange(SYMBOLS) == 0, 1, WIDTH))

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        bound = math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))
        return abs(f1 / n1 - f2 / n2) > bound

    def _compatible(self, a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            n1, n2 = self.seen[a], self.seen[b]
            if min(n1, n2) < self.min_count:
                continue
            if self._differ(self.ends[a], n1, self.ends[b], n2):
                return False
            for c in self.to[a].keys() | self.to[b].keys():
                if self._differ(self.times[a].get(c, 0), n1, self.times[b].get(c, 0), n2):
                    return False
                if c in self.to[a] and c in self.to[b]:
                    stack.append((self.to[a][c], self.to[b][c]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Add the counts of the subtree at ``tree`` to the states from ``into`` on."""
        stack = [(into, tree)]
        while stack:
            a, b = stack.pop()
            self.seen[a] += self.seen[b]
            self.ends[a] += self.ends[b]
            for c, t in self.to[b].items():
                self.times[a][c] = self.times[a].get(c, 0) + self.times[b][c]
                if c in self.to[a]:
                    stack.append((self.to[a][c], t))
                else:
                    self.to[a][c] = t

    def log_likelihood(self, code: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Natural log of the likelihood of each run ``code[start:start + size]``, its end included; all
        runs go from symbol to symbol together, and what is beyond the last layer is summed at once."""
        total, at = np.zeros(len(starts)), np.zeros(len(starts), np.int64)
        live, place, last, sums = np.arange(len(starts)), 0, len(self.log) - 1, None
        while len(live):
            live = live[(sizes[live] > place) & (at[live] < last)]
            c = code[starts[live] + place]
            total[live] += self.log[at[live], c]
            at[live] = self.step[at[live], c]
            place += 1
            far = live[(at[live] == last) & (sizes[live] > place)]
            if len(far):
                sums = sums if sums is not None else np.concatenate([[0.0], np.cumsum(self.log[last, code])])
                total[far] += sums[starts[far] + sizes[far]] - sums[starts[far] + place]
        return total + self.log[at, 0]


class Background:
    """Likelihood of a run as an ordinary one: the better of each character given the two before it, and of
    each class (digit, lower, upper, others) given the two before it with the character given its class.
    Counts are of three symbols in a row (0 before the run and at its end)."""

    def __init__(self, counts: np.ndarray, weight: float = 4.0):
        """counts: by code of three symbols, SYMBOLS ** 3 numbers."""
        three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        wide = np.where(np.arange(SYMBOLS) == 0, 1, WIDTH)
        one = three.sum(axis=(0, 1))
        kinds = KIND.max() + 1
        shrunk = np.zeros((kinds, kinds, kinds))
        np.add.at(shrunk, (KIND[:, None, None], KIND[None, :, None], KIND[None, None, :]), three)
        within = (one + wide) / np.bincount(KIND, one + wide)[KIND]
        self.logs = [_given_two(three, wide / wide.sum(), weight) - np.log(wide), (_given_two(shrunk, np.full(kinds, 1 / kinds), weight)[np.ix_(KIND, KIND, KIND)] + np.log(within) - np.log(wide))]
        self.logs = [x.ravel() for x in self.logs]

    def log_likelihood(self, code: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """As that of an automaton. Each run is followed by a 0 in ``code``."""
        here, out = triples(code), []
        for log in self.logs:
            sums = np.concatenate([[0.0], np.cumsum(log[here])])
            out.append(sums[starts + sizes + 1] - sums[starts])
        return np.maximum(*out)


class Repeats:
    """Likelihood of a run as a pattern that repeats (lines of dashes and the like): mostly each symbol is
    that of some places before, at the best of a few distances."""

    DISTANCES = (1, 2, 3, 4)

    def log_likelihood(self, code: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        place, best = np.arange(len(code)) - np.repeat(starts, sizes + 1), None
        for k in self.DISTANCES:
            same = np.zeros(len(code), bool)
            same[k:] = (code[k:] == code[:-k]) & (place[k:] >= k)
            sums = np.concatenate([[0], np.cumsum(np.where(same, math.log(0.9) - np.log(WIDTH[code]), math.log(0.1 / WIDTH[1:].sum())))])
            total = sums[starts + sizes] - sums[starts] + math.log(0.05)
            best = total if best is None else np.maximum(best, total)
        return best


def _given_two(three: np.ndarray, flat: np.ndarray, weight: float) -> np.ndarray:
    """Log-probability of a third symbol given two, each order of counts smoothed by the one below."""
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + flat) / (one.sum() + 1)
    p2 = (two + weight * p1) / (two.sum(axis=1, keepdims=True) + weight)
    return np.log((three + weight * p2) / (three.sum(axis=2, keepdims=True) + weight))


def triples(code: np.ndarray) -> np.ndarray:
    """For each symbol its code with the two before it; before a run's first symbol stand zeros."""
    x = code.astype(np.int64)
    one = np.concatenate([[0], x[:-1]])
    two = np.where(one == 0, 0, np.concatenate([[0, 0], x[:-2]])[: len(x)])
    return (two * SYMBOLS + one) * SYMBOLS + x


def joined_runs(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all runs, each followed by a 0, and where each starts and how long it is."""
    sizes = np.fromiter(map(len, runs), np.int64, len(runs))
    return CODE[np.frombuffer(b" ".join(runs) + b" ", np.uint8)], np.cumsum(sizes + 1) - sizes - 1, sizes


class Model:
    """Automata by format, and the models of ordinary runs.

    A run is reported if the best format is likelier than the best ordinary model by ``threshold`` (natural
    log) a character and by ``total`` altogether, so short runs need more a character.
    """

    def __init__(self, labelled: list[tuple[str, str]], counts: np.ndarray | None = None, threshold: float = 0.35, total: float = 12.0):
        self.threshold, self.total = threshold, total
        by: dict[str, list[str]] = {}
        for text, name in labelled:
            by.setdefault(name, []).append(text)
        code = joined_runs([x.encode() for x in by.pop("word", [])])[0]
        own = np.bincount(triples(code), minlength=SYMBOLS**3).astype(float)
        if counts is not None:
            # what one run alone has tells nothing about others; names made by rule weigh as much as the table's runs
            counts = np.maximum(counts - 1.0, 0)
            own = own * max(1.0, counts.sum() / max(1.0, own.sum())) + counts
        self.background = Background(own)
        self.names = sorted(x for x in by if not x.startswith("word-"))
        self.formats = {name: Automaton(by[name]) for name in self.names}
        self.ordinary = [Repeats(), *(Automaton(by[name]) for name in sorted(by) if name.startswith("word-"))]

    def scores(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Each run's best log-likelihood ratio a character, and the number of its format."""
        if not runs:
            return np.zeros(0), np.zeros(0, np.int64)
        code, starts, sizes = joined_runs(runs)
        base = np.max([x.log_likelihood(code, starts, sizes) for x in (self.background, *self.ordinary)], axis=0)
        ratio = np.stack([self.formats[n].log_likelihood(code, starts, sizes) - base for n in self.names])
        best = ratio.argmax(axis=0)
        return ratio[best, np.arange(len(runs))] / sizes, best

    def told(self, score: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return (score >= self.threshold) & (score * sizes >= self.total)

    def score(self, text: str) -> tuple[float, str]:
        score, best = self.scores([text.encode()])
        return float(score[0]), self.names[best[0]]


def runs_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct runs of token characters of all texts, their numbers one after another, and where each
    text's numbers begin and end."""
    split = pc.ascii_split_whitespace(pa.array([x.translate(RUNS) for x in texts], pa.large_binary()).cast(pa.large_string()))
    coded = split.flatten().dictionary_encode()
    offsets = split.offsets.to_numpy()
    return coded.dictionary, coded.indices.to_numpy(), offsets - offsets[0]


def _distinct():
    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        runs = runs_of(utf8(batch.column(0)))[0]
        runs = runs.filter(pc.invert(pc.match_substring_regex(runs, "[0-9a-f]{24}|AKIA[A-Z0-9]{16}")))
        return pa.RecordBatch.from_arrays([runs.cast(pa.string())], names=["run"])

    return f


def _triples(batches):
    counts = np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        runs = [x.encode() for x in batch.column(0).to_pylist() if x]
        if runs:
            code, _, sizes = joined_runs(runs)
            # a run counts once for each of its triples, however often it repeats it
            own = np.unique(np.repeat(np.arange(len(runs)), sizes + 1) * SYMBOLS**3 + triples(code))
            counts += np.bincount(own % SYMBOLS**3, minlength=SYMBOLS**3)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["triple", "n"])


def background(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """For three symbols in a row the number of distinct runs of the whole table that have them, but for runs
    with long hexadecimal or access keys. Each run counts once, so that a credential that stands in many
    copies does not become ordinary by its number."""
    runs = docs.select(F.col(text_col).cast("string").alias("text")).transform(arrow_map, per_batch(_distinct), "run string").distinct()
    found = runs.transform(arrow_map, _triples, "triple long, n long").groupBy("triple").agg(F.sum("n").alias("n")).toPandas()  # at most SYMBOLS ** 3 rows
    counts = np.zeros(SYMBOLS**3, np.int64)
    counts[found["triple"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return counts


def fit(labelled: DataFrame | None = None, docs: DataFrame | None = None, max_rows: int = 20_000, threshold: float = 0.35, total: float = 12.0, text_col: str = "text") -> Model:
    """Infer the automata from (credential, format) rows, at most ``max_rows`` of them by hash order.

    Without a table the rule-made credentials serve. Rows whose format begins with "word" are ordinary
    runs; if there are none, the rule-made ones are added. With ``docs`` the distinct runs of its texts are background
    too. Null or empty credentials are skipped.
    """
    rows = labelled_credentials()
    if labelled is not None:
        own = labelled.where("credential <> '' and format is not null").orderBy(F.xxhash64("credential", "format")).limit(max_rows)
        given = [(r["credential"], r["format"]) for r in own.collect()]
        words = [] if any(f.startswith("word") for _, f in given) else [x for x in rows if x[1].startswith("word")]
        rows = [*given, *words] if given else rows
    return Model(rows, None if docs is None else background(docs, text_col), threshold, total)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches by start, then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(out)


class Overlap:
    """Whether a span overlaps any of a list sorted by start, in the logarithm of their number."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))

    def __call__(self, a: int, b: int) -> bool:
        before = bisect_left(self.starts, b)
        return before > 0 and self.ends[before - 1] > a


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


class Scan:
    """What was found in one text: base spans, all spans, matches (start, end, format, score, whether a
    base span overlaps), how many candidates were scored and the best score among them."""

    __slots__ = ("base", "best", "candidates", "matches", "spans")

    def __init__(self, base, spans, matches, candidates, best):
        self.base, self.spans, self.matches, self.candidates, self.best = base, spans, matches, candidates, best


def scan(texts: list[bytes], model: Model) -> list[Scan]:
    """All runs of the texts are scored, each distinct one once."""
    runs, numbers, offsets = runs_of(texts)
    sizes = pc.binary_length(runs).to_numpy()
    long = np.flatnonzero(sizes >= LEAST)
    score, told, form = np.full(len(runs), -np.inf), np.zeros(len(runs), bool), np.zeros(len(runs), np.int64)
    score[long], form[long] = model.scores([x.encode() for x in runs.take(pa.array(long)).to_pylist()])
    told[long] = model.told(score[long], sizes[long])
    out = []
    for k, raw in enumerate(texts):
        own = numbers[offsets[k] : offsets[k + 1]]
        scored = own[sizes[own] >= LEAST]
        best = float(score[scored].max()) if len(scored) else None
        hit = bool(told[own].any())
        lower = raw.lower()
        # hexadecimal runs of 24 and access keys of 20 characters are runs too
        if not hit and not (len(own) and sizes[own].max() >= 20) and not any(x in lower for x in KEYWORDS):
            out.append(Scan([], [], [], len(scored), best))
            continue
        text = raw.decode()
        base, matches, more = base_spans(text), [], []
        if hit:
            names = {runs[int(n)].as_py().encode(): int(n) for n in np.unique(own[told[own]])}
            done, place = 0, 0
            known = Overlap([(x, y) for x, _, y in base])
            for m in CANDIDATE.finditer(raw):
                n = names.get(m[0])
                if n is None:
                    continue
                place += len(raw[done : m.start()].decode())
                done = m.start()
                a, b = place, place + len(m[0])
                within = known(a, b)
                matches.append((a, b, model.names[form[n]], float(score[n]), within))
                if not within:
                    more.append((a, 3, b))
        out.append(Scan(base, sorted([*base, *more]), matches, len(scored), best))
    return out


MATCHES = "matches array<struct<start:long,end:long,format:string,score:double,within_base:boolean>>"


def secret_scan(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, counts of the base kinds, base_sha256, spans, n_inferred, max_score,
    n_candidates (all runs scored), n_scored_base (base spans that a scored run above the threshold
    confirms), matches.

    Spans are ``kind:start:end`` in code points of the whole match, end exclusive, by start and then
    kind. Inferred spans never replace or overlap base ones; runs that do are in ``matches`` only. A map
    without any shuffle. Null texts count as empty: no spans, and the digest of the empty string.
    Repeated rows are kept. Without a model one is fitted whose background holds the table's runs.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model or fit(docs=docs, text_col=text_col))
    match = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("format", pa.string()), ("score", pa.float64()), ("within_base", pa.bool_())]))
    types = {"n_assign": pa.int64(), "n_access": pa.int64(), "n_hex": pa.int64(), "base_sha256": pa.string(), "spans": pa.string(), "n_inferred": pa.int64(), "max_score": pa.float64(), "n_candidates": pa.int64(), "n_scored_base": pa.int64(), "matches": match}

    def make():
        ready = shared.value

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for x in scan(utf8(batch.column(1)), ready):
                kinds = [k for _, k, _ in x.base]
                scored = Overlap([m[:2] for m in x.matches])
                confirmed = sum(scored(a, b) for a, _, b in x.base)
                found = [dict(zip(("start", "end", "format", "score", "within_base"), m, strict=True)) for m in x.matches]
                rows.append((*(kinds.count(k) for k in range(3)), hashlib.sha256(joined(x.base).encode()).hexdigest(), joined(x.spans), len(x.spans) - len(x.base), x.best, x.candidates, confirmed, found))
            cols = zip(*rows, strict=True) if rows else [[]] * len(types)
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types.values(), strict=True))], names=["doc_id", *types])

        return f

    schema = f"doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_inferred long, max_score double, n_candidates long, n_scored_base long, {MATCHES}"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).transform(arrow_map, per_batch(make), schema)


def redact(docs: DataFrame, model: Model | None = None, mask: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """``docs`` with every span (base and inferred, overlapping ones as one) replaced by ``mask``.

    All rows and columns stay; null texts stay null and texts without spans stay as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs=docs, text_col=text_col))
    at = docs.columns.index(text_col)

    def make():
        ready = shared.value

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(at).to_pylist()
            for k, x in enumerate(scan(utf8(batch.column(at)), ready)):
                if x.spans:
                    text, out, begin = texts[k], [], 0
                    for a, _, b in x.spans:
                        if a >= begin:
                            out += [text[begin:a], mask]
                        begin = max(begin, b)
                    texts[k] = "".join([*out, text[begin:]])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        return f

    return docs.transform(arrow_map, per_batch(make), docs.schema)
