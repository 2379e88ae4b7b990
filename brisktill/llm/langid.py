"""Language identification with hyperdimensional profiles."""

import functools
import unicodedata

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import map_batches

DIMENSIONS = 1024
GRAM = 3
UNKNOWN = "und"
# Language labels are codes; a column with more values is no language column.
MOST_LANGUAGES = 10_000
# Characters that are bundled at once, and n-gram vectors that a worker keeps.
_AT_ONCE = 1 << 18
_KEPT = 16_384
_SPACE = 0


@functools.lru_cache(maxsize=1 << 16)
def letter_vector(code, seed=5):
    """The random signs of a letter, the same in every task; code 0 stands for a gap between words."""
    return np.random.default_rng([seed, code]).choice(np.array([-1, 1], np.int8), DIMENSIONS)


def gram_vector(codes):
    """The letters' vectors, each turned once for every letter after it, bound by products."""
    bound = np.ones(DIMENSIONS, np.int8)
    for at, code in enumerate(codes):
        bound = bound * np.roll(letter_vector(int(code)), len(codes) - 1 - at)
    return bound


class Letters:
    """Which code points are letters, looked up once each."""

    def __init__(self):
        self.known = np.zeros(0x110000, np.int8)

    def of(self, codes):
        for code in np.unique(codes[self.known[codes] == 0]):
            self.known[code] = 1 if unicodedata.category(chr(code))[0] == "L" else -1
        return self.known[codes] > 0


class Bundler:
    """Document vectors: sums of the vectors of all n-grams of a text."""

    def __init__(self):
        self.letters = Letters()
        self.rows = {}
        self.store = np.zeros((_KEPT, DIMENSIONS), np.float32)

    def _vectors(self, grams):
        """Vectors of distinct n-grams (rows of codes), kept from call to call while there is room."""
        keys = [g.tobytes() for g in grams]
        if len(self.rows) + len(keys) > _KEPT:
            self.rows.clear()
        if len(keys) > _KEPT:
            return np.array([gram_vector(g) for g in grams], np.float32)
        for key, gram in zip(keys, grams, strict=True):
            if key not in self.rows:
                self.rows[key] = len(self.rows)
                self.store[self.rows[key]] = gram_vector(gram)
        return self.store[[self.rows[key] for key in keys]]

    def _spelled(self, text):
        """Codes of the lower-cased letters, other characters as single gaps; empty if there is no letter."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        letter = self.letters.of(codes)
        if not letter.any():
            return codes[:0]
        codes = np.where(letter, codes, _SPACE)
        gap = np.concatenate([[False], (codes[1:] == _SPACE) & (codes[:-1] == _SPACE)])
        codes = codes[~gap]
        head, tail = [_SPACE][: int(codes[0] != _SPACE)], [_SPACE][: int(codes[-1] != _SPACE)]
        return np.concatenate([np.array(head, np.int64), codes, np.array(tail, np.int64)])

    def bundle(self, texts):
        """(vectors, has letters) of texts; a long text is bundled part by part, the parts overlapping by an n-gram less one."""
        out = np.zeros((len(texts), DIMENSIONS), np.int64)
        lettered = np.zeros(len(texts), bool)
        waiting, size = [], 0
        for i, text in enumerate(texts):
            codes = self._spelled(text or "")
            lettered[i] = len(codes) > 0
            for at in range(0, max(0, len(codes) - GRAM + 1), _AT_ONCE):
                waiting.append((i, codes[at : at + _AT_ONCE + GRAM - 1]))
                size += len(waiting[-1][1])
                if size >= _AT_ONCE:
                    self._add(waiting, out)
                    waiting, size = [], 0
        if waiting:
            self._add(waiting, out)
        return out, lettered

    def _add(self, parts, out):
        alphabet, spelled = np.unique(np.concatenate([codes for _, codes in parts]), return_inverse=True)
        k, at, keys, owners = len(alphabet), 0, [], []
        for row, (_, codes) in enumerate(parts):
            own = spelled[at : at + len(codes)]
            at += len(codes)
            key = np.zeros(len(codes) - GRAM + 1, np.int64)
            for j in range(GRAM):
                key = key * k + own[j : j + len(key)]
            keys.append(key)
            owners.append(np.full(len(key), row))
        grams, which = self._distinct(np.concatenate(keys), k**GRAM)
        codes = np.stack([alphabet[grams // k ** (GRAM - 1 - j) % k] for j in range(GRAM)], 1)
        flat = np.bincount(np.concatenate(owners) * len(grams) + which, minlength=len(parts) * len(grams))
        counts = flat.reshape(len(parts), len(grams)).astype(np.float32)
        for first in range(0, len(grams), _KEPT // 2):
            some = slice(first, first + _KEPT // 2)
            sums = counts[:, some] @ self._vectors(codes[some])
            np.add.at(out, [i for i, _ in parts], np.rint(sums).astype(np.int64))

    @staticmethod
    def _distinct(keys, space):
        if space > 1 << 22:
            return np.unique(keys, return_inverse=True)
        seen = np.zeros(space, bool)
        seen[keys] = True
        grams = np.flatnonzero(seen)
        place = np.zeros(space, np.int64)
        place[grams] = np.arange(len(grams))
        return grams, place[keys]


_BUNDLER = []


def bundler():
    """This worker's bundler; tasks share it."""
    if not _BUNDLER:
        _BUNDLER.append(Bundler())
    return _BUNDLER[0]


def held_out(id_column):
    """Documents that are kept from learning: crc32 of the id as text is divisible by five (a null id: of an empty one)."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(samples, text_col="text", lang_col="lang"):
    """(languages, prototypes): for each label the sum of its documents' vectors, over all rows of `samples` with text and label.

    Tasks add up vectors per label before the shuffle. What comes to the driver
    is one vector per label; a column with more than `MOST_LANGUAGES` values is refused.
    """
    own = samples.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    schema = "lang string, at int, n long"

    def run(batches):
        import pyarrow as pa

        sums = {}
        for batch in batches:
            for part in range(0, batch.num_rows, 64):
                texts, langs = (c.to_pylist() for c in batch.slice(part, 64).columns)
                vectors, _ = bundler().bundle(texts)
                for lang, vector in zip(langs, vectors, strict=True):
                    sums[lang] = sums.get(lang, 0) + vector
        for lang, vector in sums.items():
            columns = [pa.array([lang] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(vector)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "at", "n"])

    sums = own.mapInArrow(run, schema).groupBy("lang", "at").agg(F.sum("n").alias("n"))
    whole = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "n"))), lambda x: x["n"]).alias("v"))
    found = sorted(whole.limit(MOST_LANGUAGES + 1).collect())
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MOST_LANGUAGES} values")
    found = [(lang, vector) for lang, vector in found if any(vector)]
    return [lang for lang, _ in found], np.array([v for _, v in found], float).reshape(len(found), DIMENSIONS)


def predict(docs, languages, prototypes, id_col="doc_id", text_col="text"):
    """One row (id, lang_pred, score) per row of `docs`: the label whose prototype has the largest cosine with the document.

    Equal cosines go to the label that sorts first. A null text, one without a
    letter, or one without any prototype to compare with is `und` with score 0;
    negative cosines score 0.
    """
    schema = T.StructType(
        [docs.select(id_col).schema[0], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    unit = prototypes / np.linalg.norm(prototypes, axis=1, keepdims=True) if languages else prototypes

    def start():
        def work(batch):
            texts, labels, scores = batch.column(1).to_pylist(), [], []
            for part in range(0, len(texts), 64):
                vectors, lettered = bundler().bundle(texts[part : part + 64])
                if not languages:
                    labels += [UNKNOWN] * len(vectors)
                    scores += [0.0] * len(vectors)
                    continue
                length = np.linalg.norm(vectors.astype(float), axis=1)
                cosine = np.round(vectors @ unit.T / np.maximum(length, 1)[:, None], 9)
                best = cosine.argmax(1)
                top = np.clip(cosine[np.arange(len(best)), best], 0, 1)
                labels += [languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
                scores += np.where(lettered, top, 0.0).tolist()
            return [batch.column(0), labels, scores]

        return work

    return map_batches(docs.select(id_col, text_col), start, schema)


def identify(docs, id_col="doc_id", text_col="text", lang_col="lang"):
    """One row (id, held_out, lang_pred, score) per row of `docs`, learned from the labelled rows that are not held out.

    Labels, sources and ids are no inputs of a prediction. Repeated rows are
    judged one by one; an empty table gives no rows.
    """
    model = learn(docs.filter(~held_out(F.col(id_col))), text_col, lang_col)
    found = predict(docs, *model, id_col, text_col)
    return found.select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")
