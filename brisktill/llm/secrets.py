"""Secrets in text: fixed patterns, and random-looking strings by character Markov models."""

import bisect
import hashlib
import itertools
import re

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import map_batches

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ASSIGN_LENGTH = 12
# A run that is long enough is found as a whole; shorter ones fail and hold no longer one.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")

# Symbols of the models; the index after the last stands for the beginning of a string.
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-+/=."
_START = len(SYMBOLS)
_CODE = np.full(128, -1, np.int64)
_CODE[[ord(c) for c in SYMBOLS]] = np.arange(_START)
# Strings the models judge: runs of the symbols, whatever stands beside them, with some letters. The ratio decides on the length.
LEAST_LETTERS = 4
# Words of one case, with a number or not, may be of a language that the sample lacks: under this length they are none.
LEAST_LENGTH = 20
_WORDS = re.compile(r"(?:[+/=._-]|(?<![A-Za-z0-9])(?:[A-Z]?[a-z]*|[A-Z]+)[0-9]*(?![A-Za-z0-9]))+")
# Letters of words that such a run may be a part of: plain words beside them are no strings of their own.
_ACCENTED = re.compile("[\u00c0-\u024f\u0300-\u036f\u1e00-\u1eff]")
_PART = re.compile(r"[A-Za-z0-9]+")
_RUN = re.compile(r"[A-Za-z0-9+/=._-]+")
# Alphabets of random strings; each has a model of its own and the likeliest counts. The last one takes every string.
ALPHABETS = {
    "hex": SYMBOLS[52:62] + "abcdef",
    "upper": SYMBOLS[:26] + SYMBOLS[52:62],
    "base64": SYMBOLS[:62] + "+/=",
    "url": SYMBOLS[:64],
    "any": SYMBOLS,
}
ORDINARY = "ordinary"
MODELS = (*ALPHABETS, ORDINARY)

# Documents that the models are fitted on (about; all if there are fewer), and random strings made per alphabet.
SAMPLE_DOCUMENTS = 2_000
MADE = 2_000
# Judged strings that a worker keeps between texts.
KEPT_STRINGS = 1 << 17
# A string is a secret if its log-likelihood ratio reaches both, in nats.
LEAST_RATIO = 15.0
LEAST_RATIO_PER_CHARACTER = 1.0


def base_spans(text):
    """(start, kind index, end, start of the value) of the fixed patterns, ordered by start and kind."""
    spans = [
        (m.start(), 0, m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if m.end() - m.start(2) >= _ASSIGN_LENGTH
    ]
    for kind, pattern in ((1, _ACCESS), (2, _HEX)):
        spans += [(m.start(), kind, m.end(), m.start()) for m in pattern.finditer(text)]
    return sorted(spans)


def _codes(text):
    return _CODE[np.frombuffer(text.encode("ascii"), np.uint8)]


def _cells(strings):
    """Transitions of ASCII strings over SYMBOLS as flat indices, each string with its beginning."""
    if not strings:
        return np.zeros(0, np.int64)
    after = np.concatenate([_codes(s) for s in strings])
    before = np.roll(after, 1)
    before[np.cumsum([0, *map(len, strings[:-1])])] = _START
    return before * _START + after


def _count(cells):
    return np.bincount(cells, minlength=(_START + 1) * _START)


def _identifiers(words):
    """Identifiers as programmers join words, and paths and hosts: three at a time, in eight styles."""
    for i in range(0, len(words) - 2, 3):
        part = [w.lower() for w in words[i : i + 3]]
        yield from ("_".join(part), "-".join(part), "_".join(part).upper(), part[0] + "".join(w.title() for w in part[1:]))
        yield from ("/" + "/".join(part), ".".join(part), f"//www.{part[0]}.{part[1]}/{part[2]}", f"{part[0]}{len(part[1]) % 10}.{part[2]}")


def labelled_strings(text):
    """The labelled strings of one text: (model, string). What the fixed patterns find is random, the rest ordinary."""
    at = 0
    plain = []
    for start, _, end, value in base_spans(text):
        plain += _RUN.findall(text[at : max(at, start)])
        at = max(at, end)
        for run in _RUN.findall(text[value:end]):
            yield next(name for name, alphabet in ALPHABETS.items() if set(run) <= set(alphabet)), run
    plain += _RUN.findall(text[at:])
    words = [w.strip("+/=._-") for w in plain]
    for string in (*plain, *_identifiers([w for w in words if w.isalpha()])):
        yield ORDINARY, string


def made_strings(seed=7, each=MADE, length=32):
    """Random strings per alphabet, the same for the same seed."""
    rng = np.random.default_rng(seed)
    return {name: ["".join(row) for row in rng.choice(list(a), (each, length))] for name, a in ALPHABETS.items()}


def sampled(docs, text_col, sample_documents, id_col="doc_id"):
    """The texts of about `sample_documents` rows that have one, picked by a hash of id and text."""
    total = max(1, docs.count())
    steps = 1 << 20
    named = [id_col] if id_col in docs.columns else []
    picked = F.pmod(F.xxhash64(*named, text_col), F.lit(steps)) < min(steps, steps * sample_documents // total)
    return docs.filter(F.col(text_col).isNotNull() & picked).select(F.col(text_col).alias("text"))


def fit(docs, text_col="text", sample_documents=SAMPLE_DOCUMENTS, seed=7, id_col="doc_id"):
    """The models: log probabilities [model, before, after], from the labelled strings of a sample of `docs`.

    The sample takes documents by a hash of their id (if there is such a column) and text, about
    `sample_documents` of them, also of a table of copies; transitions are counted in the tasks and only
    the counts, of fixed number, come to the driver. Made random strings join
    those found, so no model lacks samples, whatever `docs` holds.
    """
    part = sampled(docs, text_col, sample_documents, id_col)

    def start():
        def work(batch):
            found = {name: [] for name in MODELS}
            counts = {name: np.zeros((_START + 1) * _START, np.int64) for name in MODELS}
            for text in batch.column(0).to_pylist():
                for name, string in labelled_strings(text):
                    found[name].append(string)
                for name, strings in found.items():
                    counts[name] += _count(_cells(strings))
                    strings.clear()
            rows = [(m, c, counts[name][c]) for m, name in enumerate(MODELS) for c in np.flatnonzero(counts[name])]
            return [list(column) for column in zip(*rows, strict=True)] if rows else [[], [], []]

        return work

    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("model", "cell", "n")])
    sums = map_batches(part, start, schema).groupBy("model", "cell").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((len(MODELS), (_START + 1) * _START))
    for model, cell, n in sums:
        counts[model, cell] = n
    for name, strings in made_strings(seed).items():
        counts[MODELS.index(name)] += _count(_cells(strings))
    # Ordinary text smooths evenly; a random model gives what its alphabet lacks next to nothing.
    smooth = np.array([[1e-6 if name in ALPHABETS else 0.5] for name in MODELS])
    table = (counts + smooth).reshape(len(MODELS), _START + 1, _START)
    return np.log(table / table.sum(2, keepdims=True))


def ratio(models, string):
    """Log-likelihood of the likeliest random model less that of the ordinary one."""
    cells = _cells([string])
    by_model = models.reshape(len(MODELS), -1)[:, cells].sum(1)
    return float(by_model[:-1].max() - by_model[-1])


def _random(models, gains, run):
    """(start, end) of the stretches of a run of symbols that the models take for random.

    A stretch goes from one part of letters and digits to another; the one with
    the highest ratio is judged, then what lies on either side of it. So the
    score splits URLs, paths and assignments, and a key with symbols stays whole.
    """
    parts = [m.span() for m in _PART.finditer(run)]
    cells = _cells([run])
    # Before a part and after it, per model: what all symbols up to there gain over the ordinary model.
    sums = np.concatenate([np.zeros((len(gains), 1)), np.cumsum(gains[:, cells], 1)], 1)
    found, todo = [], [(0, len(parts))]
    while todo:
        low, high = todo.pop()
        if low >= high:
            continue
        starts, ends = np.array(parts[low:high]).T
        before, after = sums[:, starts], sums[:, ends]
        least = np.minimum.accumulate(before, 1)
        model, last = np.unravel_index((after - least).argmax(), after.shape)
        first = int(before[model, : last + 1].argmin()) + low
        last = int(last) + low
        start, end = parts[first][0], parts[last][1]
        # Symbols at the ends of the run belong to it, the dot of a sentence does not.
        if first == 0:
            start -= len(run[:start]) - len(run[:start].rstrip("+/_-"))
        if last == len(parts) - 1:
            end += len(run[end:]) - len(run[end:].lstrip("+/=_-"))
        string = run[start:end]
        gain = float(sums[model, parts[last][1]] - sums[model, parts[first][0]])
        if max(gain, value := ratio(models, string)) < LEAST_RATIO:
            continue
        words = len(string) < LEAST_LENGTH and _WORDS.fullmatch(string)
        if not words and sum(map(str.isalpha, string)) >= LEAST_LETTERS and value >= max(LEAST_RATIO, LEAST_RATIO_PER_CHARACTER * len(string)):
            found.append((start, end))
        todo += [(low, first), (last + 1, high)]
    return found


def all_spans(models, text, known=None):
    """The base spans and, where they leave room, strings that the models take for random.

    `known` keeps what was found in runs seen before.
    """
    known = {} if known is None else known
    spans = base_spans(text)
    starts = [start for start, _, _, _ in spans]
    reach = list(itertools.accumulate((end for _, _, end, _ in spans), max))
    gains = (models[:-1] - models[-1]).reshape(len(MODELS) - 1, -1)
    for m in _RUN.finditer(text):
        run = m.group()
        beside = not text.isascii() and (_ACCENTED.match(text, m.end()) or m.start() and _ACCENTED.match(text, m.start() - 1))
        if (len(run) < LEAST_LENGTH or beside) and _WORDS.fullmatch(run):  # and so is every stretch of it
            continue
        if (inside := known.get(run)) is None:
            if len(known) >= KEPT_STRINGS:
                known.clear()
            inside = known[run] = _random(models, gains, run) if any(map(str.isalnum, run)) else []
        for start, end in inside:
            start, end = m.start() + start, m.start() + end
            before = bisect.bisect_left(starts, end)  # the base spans that begin before the string ends
            if not before or reach[before - 1] <= start:
                spans.append((start, 3, end, start))
    return sorted(spans)


def joined(spans):
    """kind:start:end, comma-joined; code points, ends exclusive."""
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end, _ in spans)


def redacted(text, spans):
    """The text with each secret's value replaced by its kind in brackets; overlapping values become one."""
    out, at, last = [], 0, None
    for value, end, kind in sorted((value, end, kind) for _, kind, end, value in spans):
        if value >= at or last is None:
            out += [text[at:value], f"[{KINDS[kind]}]"]
            last = kind
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(docs, id_col="doc_id", text_col="text", models=None, sample_documents=SAMPLE_DOCUMENTS):
    """One row per row of `docs`: id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    A null or empty text has no spans; repeated rows are scanned one by one; an
    empty table gives no rows.
    """
    models = fit(docs, text_col, sample_documents) if models is None else models
    schema = T.StructType(
        [
            docs.select(id_col).schema[0],
            *[T.StructField(f"n_{kind}", T.LongType()) for kind in KINDS],
            T.StructField("base_sha256", T.StringType()),
            T.StructField("spans", T.StringType()),
        ]
    )

    def start():
        known = {}

        def work(batch):
            found = [all_spans(models, text or "", known) for text in batch.column(1).to_pylist()]
            counts = [[sum(s[1] == k for s in spans) for spans in found] for k in range(len(KINDS))]
            base = [joined([s for s in spans if KINDS[s[1]] != "random"]) for spans in found]
            digests = [hashlib.sha256(b.encode()).hexdigest() for b in base]
            return [batch.column(0), *counts, digests, [joined(spans) for spans in found]]

        return work

    return map_batches(docs.select(id_col, text_col), start, schema)


def redact(docs, text_col="text", length_col="n_chars", models=None, sample_documents=SAMPLE_DOCUMENTS):
    """The rows of `docs`, columns unchanged, with secrets replaced in the text and its length brought up to date.

    A null text stays null. Without a column `length_col` only the text changes.
    """
    models = fit(docs, text_col, sample_documents) if models is None else models
    at = docs.columns.index(text_col)

    def start():
        known = {}

        def work(batch):
            texts = [t if t is None else redacted(t, all_spans(models, t, known)) for t in batch.column(at).to_pylist()]
            return [texts if i == at else batch.column(i) for i in range(batch.num_columns)]

        return work

    out = map_batches(docs, start, docs.schema)
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        changed = ~F.length(text_col).eqNullSafe(F.col(length_col)) & F.col(text_col).isNotNull()
        out = out.withColumn(length_col, F.when(changed, F.length(text_col).cast(kind)).otherwise(F.col(length_col)))
    return out
