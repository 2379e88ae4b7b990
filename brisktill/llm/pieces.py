"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

For a model whose pieces have log probabilities (unigram), the search keeps the
best score of each prefix. For a merge model (BPE) a segmentation is the
library's if and only if each two neighbouring pieces are what merging gives
for their concatenation, so the search scores a transition 0 if that holds and
minus infinity otherwise; one piece survives at each position, and the ids are
those of the merge order.
"""

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import tokenizer_path

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
# A run of spaces and what follows it up to the next. No piece has a space after another character, so none crosses.
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_NORMAL, _UNKNOWN, _BYTE = 1, 2, 6
_MERGES, _UNIGRAM = 2, 1
# Ids of chunks kept by a worker, and the longest chunk kept.
_KEPT = 300_000
_LONGEST = 64
# Words whose lengths differ by less than a part in this advance together; the shorter ones are padded.
_PADDING = 16
# Longer words are searched one by one.
_ALONE = 256
_AT_ONCE = 1 << 20
_MARK_SHIFT = np.uint64(44)
# Texts that are encoded together: so many at most, of so many characters in all (or one).
_TEXTS, _CHARACTERS = 1024, 1 << 22


def _model(path):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    return proto


def _codes(word):
    return np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4")


def _powers(base, n):
    """base to the power of 0 to n - 1, modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Pieces:
    """A model's vocabulary as sorted substring hashes."""

    def __init__(self, path):
        proto = _model(path)
        spec = proto.normalizer_spec
        if spec.name != "identity" or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models that leave text as it is, but for its spaces, are supported")
        self.merges = proto.trainer_spec.model_type == _MERGES
        if not self.merges and proto.trainer_spec.model_type != _UNIGRAM:
            raise ValueError("neither a merge nor a unigram model")
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        self.text = [p.piece for p in proto.pieces]
        self.score = np.array([p.score for p in proto.pieces])
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == _NORMAL}
        self.cost = {piece: -float(self.score[i]) for piece, i in self.ids.items()}
        if any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in self.ids):
            raise ValueError("a piece crosses words")
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == _BYTE}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == _UNKNOWN)
        self.kinds = np.array([p.type for p in proto.pieces])
        self.count = len(self.text)
        self.longest = max(map(len, self.ids), default=1)
        # Below the worst piece, as the library scores a character that is no piece.
        self.unknown_score = min((self.score[i] for i in self.ids.values()), default=0.0) - 10.0
        rng = np.random.default_rng(17)
        self.spread = rng.integers(1, 1 << 63, 1 << 12, dtype=np.uint64)
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.power = np.full(self.longest + 1, self.base, np.uint64)
        self.power[0] = 1
        self.power = np.cumprod(self.power, dtype=np.uint64)
        self.keys = {}
        for length in range(1, self.longest + 1):
            own = [(piece, i) for piece, i in self.ids.items() if len(piece) == length]
            if own:
                codes = np.array([[ord(c) for c in piece] for piece, _ in own], np.uint32)
                hashes = self.prefixes(codes)[:, -1]
                order = np.argsort(hashes)
                if len(np.unique(hashes)) < len(hashes):
                    raise ValueError("two pieces have one hash")
                self.keys[length] = hashes[order], np.array([i for _, i in own])[order]
        self.lengths = sorted(self.keys, reverse=True)
        # Most substrings are no pieces; a bit per leading bits of a hash tells so without a search.
        self.marked = np.zeros(1 << 64 - int(_MARK_SHIFT), bool)
        for hashes, _ in self.keys.values():
            self.marked[hashes >> _MARK_SHIFT] = True
        # Pairs of pieces and whether they may follow each other; -1 is no pair.
        self.judged = {}
        self.pairs = np.full(1, -1), np.zeros(1, bool)
        self.new, self.old = {}, {}
        self.pieces_bytes = pa.array([self._bytes(i) for i in range(self.count)], pa.binary())

    # Encoding

    def prefixes(self, codes):
        """Polynomial hashes of all prefixes of rows of code points, the empty one first.

        The sum over characters is a running one of values divided by powers of the base, times the power again.
        """
        values = self.spread[codes & 0xFFF] ^ (codes.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        width = codes.shape[1]
        out = np.zeros((len(codes), width + 1), np.uint64)
        np.cumsum(values * _powers(self.inverse, width), axis=1, dtype=np.uint64, out=out[:, 1:])
        out[:, 1:] *= _powers(self.base, width)
        return out

    def _merged(self, text):
        """Pieces of a short string by merging: the best-scored neighbours first, of equal ones the leftmost."""
        parts, cost = list(text), self.cost
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                own = cost.get(parts[i] + parts[i + 1])
                if own is not None and (best is None or own < best):
                    best, at = own, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _judge(self, pair):
        """Whether merging the text of two pieces, given as one number, gives just these two; kept."""
        if (known := self.judged.get(pair)) is None:
            a, b = self.text[pair // self.count], self.text[pair % self.count]
            known = self.judged[pair] = self._merged(a + b) == [a, b]
        return known

    def _agree(self, before, after):
        """Whether pieces may follow each other; -1 stands for the beginning and for characters that are no pieces.

        Judged pairs are searched in sorted arrays, which are made anew when a good part of the pairs is newer.
        """
        out = (before < 0) | (after < 0)
        inner = np.flatnonzero(~out)
        key = before[inner] * self.count + after[inner]
        known, valid = self.pairs
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        held, good = known[at] == key, valid[at]
        if not held.all():
            more, back = np.unique(key[~held], return_inverse=True)
            good[~held] = np.array([self._judge(pair) for pair in more.tolist()], bool)[back]
            if len(self.judged) > 1.25 * len(known) + 4096:
                known = np.fromiter(self.judged, np.int64, len(self.judged))
                order = np.argsort(known)
                self.pairs = known[order], np.fromiter(self.judged.values(), bool, len(known))[order]
        out[inner] = good
        return out

    def _hits(self, codes, lengths):
        """All places of pieces in rows of code points: (end, row, length, id), ordered by end, then longest first."""
        # By position, then by word: what is read together lies together.
        prefix = np.ascontiguousarray(self.prefixes(codes).T)
        found = []
        for length in self.lengths:
            if length > codes.shape[1]:
                continue
            wanted = (prefix[length:] - prefix[:-length] * self.power[length]).ravel()
            place = np.flatnonzero(self.marked[wanted >> _MARK_SHIFT])
            keys, ids = self.keys[length]
            wanted = wanted[place]
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            same = keys[at] == wanted
            end, row = place[same] // len(codes) + length, place[same] % len(codes)
            inside = end <= lengths[row]
            found.append((end[inside], row[inside], np.full(inside.sum(), length), ids[at[same]][inside]))
        if not found:
            return [np.zeros(0, np.int64)] * 4
        found = [np.concatenate(x) for x in zip(*found, strict=True)]
        order = np.argsort(found[0], kind="stable")
        return [x[order] for x in found]

    def search(self, words):
        """Ids of words (at least one character each), as bytes; all words advance a character at a time, together.

        Where pieces lie does not depend on the search, so it is found for all positions first.
        """
        if len(words) == 1 and len(words[0]) > _ALONE:
            return [self._search_long(words[0])]
        lengths = np.array([len(w) for w in words])
        width = int(lengths.max())
        codes = np.zeros((len(words), width), np.uint32)
        for row, word in enumerate(words):
            codes[row, : len(word)] = _codes(word)
        end, row, size, ids = self._hits(codes, lengths)
        bounds = np.searchsorted(end, np.arange(width + 2))
        single = np.zeros((width + 1, len(words)), bool)
        single[end[size == 1], row[size == 1]] = True
        best = np.full((width + 1, len(words)), -np.inf)
        best[0] = 0
        step = np.ones((width + 1, len(words)), np.int32)
        piece = np.full((width + 1, len(words)), -1, np.int64)
        for j in range(1, width + 1):
            part = slice(bounds[j], bounds[j + 1])
            own, long, found = row[part], size[part], ids[part]
            score = best[j - long, own]
            if self.merges:
                # One piece at most survives.
                open_ = np.flatnonzero(score == 0)
                kept = open_[self._agree(piece[j - long[open_], own[open_]], found[open_])]
            else:
                score = score + self.score[found]
                order = np.lexsort((-long, -score, own))
                kept = order[np.append(True, own[order][1:] != own[order][:-1])[: len(order)]]
                kept = kept[score[kept] > -np.inf]
            best[j, own[kept]] = 0 if self.merges else score[kept]
            step[j, own[kept]], piece[j, own[kept]] = long[kept], found[kept]
            # A character that is no piece by itself stands alone.
            alone = best[j - 1] + (0 if self.merges else self.unknown_score)
            gap = np.flatnonzero((lengths >= j) & ~single[j] & (alone > best[j]))
            best[j, gap], step[j, gap], piece[j, gap] = alone[gap], 1, -1
        return self._walked_back(words, lengths, step, piece)

    def _search_long(self, word):
        """The same for one long word: its pieces are found at once, and only the choice goes from position to position."""
        end, _, size, ids = self._hits(_codes(word)[None], np.array([len(word)]))
        n, count, judge = len(word), self.count, self._judge
        bounds = np.searchsorted(end, np.arange(n + 2)).tolist()
        size, ids = size.tolist(), ids.tolist()
        gains = None if self.merges else self.score.tolist()
        best, step, piece = [-np.inf] * (n + 1), [1] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for j in range(1, n + 1):
            here = -np.inf
            for h in range(bounds[j], bounds[j + 1]):
                i, found = j - size[h], ids[h]
                if best[i] == -np.inf:
                    continue
                if gains is None:
                    score = 0.0 if piece[i] < 0 or judge(piece[i] * count + found) else -np.inf
                else:
                    score = best[i] + gains[found]
                if score > here:
                    here, step[j], piece[j] = score, size[h], found
                    if gains is None:
                        break
            single = bounds[j] < bounds[j + 1] and size[bounds[j + 1] - 1] == 1
            alone = best[j - 1] + (0.0 if gains is None else self.unknown_score)
            if not single and alone > here:
                here, step[j], piece[j] = alone, 1, -1
            best[j] = here
        return self._walked(word, step, piece).tobytes()

    def _walked_back(self, words, lengths, step, piece):
        """The ids along the backpointers as little-endian 32-bit numbers; all words step back together."""
        every = np.arange(len(words))
        out = np.zeros((len(words), len(step)), "<i4")
        at, count, gaps = lengths.copy(), np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        left = every
        while len(left):
            found = piece[at[left], left]
            count[left] += 1
            out[left, len(step) - count[left]] = found
            gaps[left[found < 0]] = True
            at[left] -= step[at[left], left]
            left = left[at[left] > 0]
        first = len(step) - count
        return [
            self._walked(words[i], step[:, i], piece[:, i]).tobytes() if gaps[i] else out[i, first[i] :].tobytes() for i in every
        ]

    def _walked(self, word, step, piece):
        out, j = [], len(word)
        while j:
            out.append([piece[j]] if piece[j] >= 0 else self._spelled(word[j - 1]))
            j -= step[j]
        return np.array([i for part in reversed(out) for i in part], "<i4")

    def _spelled(self, character):
        return [self.byte[b] for b in character.encode("utf-8")] if self.byte else [self.unknown]

    def _learn(self, chunks):
        """Encodes chunks that are not known, those of like length together."""
        by_class = {}
        for chunk in chunks:
            size = len(chunk)
            grain = max(1, 1 << max(0, size.bit_length() - _PADDING.bit_length()))
            by_class.setdefault((grain, size // grain), []).append(chunk)
        for group in by_class.values():
            some = 1 if len(group[0]) > _ALONE // 2 and max(map(len, group)) > _ALONE else max(1, _AT_ONCE // (4 * len(group[0])))
            for first in range(0, len(group), some):
                part = group[first : first + some]
                self.new.update(zip(part, self.search(part), strict=True))

    def encode(self, texts):
        """Ids of texts (None or empty: none), equal to the library's."""
        if len(self.new) > _KEPT:
            self.old, self.new = self.new, {}
        chunked = [_CHUNK.findall(self.prefix + t.replace(" ", SPACE)) if t else [] for t in texts]
        wanted = {chunk for chunks in chunked for chunk in chunks if chunk not in self.new}
        self.new.update({chunk: self.old[chunk] for chunk in wanted if chunk in self.old})
        self._learn([chunk for chunk in wanted if chunk not in self.new])
        known = self.new
        out = [np.frombuffer(b"".join([known[c] for c in chunks]), "<i4") for chunks in chunked]
        for chunk in wanted:
            if len(chunk) > _LONGEST:
                del known[chunk]
        return out

    # Decoding

    def _bytes(self, i):
        if self.kinds[i] == _BYTE:
            return bytes([int(self.text[i][1:-1], 16)])
        if self.kinds[i] == _UNKNOWN:
            return " ⁇ ".encode()
        return self.text[i].replace(SPACE, " ").encode() if self.kinds[i] == _NORMAL else b""

    def decode(self, ids):
        """The text of ids; without the space that encoding put first, and with bytes that are no UTF-8 replaced."""
        raw = self.pieces_bytes.take(pa.array(ids))
        raw = raw.buffers()[2].to_pybytes() if len(raw) and raw.buffers()[2] else b""
        return (raw[1:] if self.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


_PIECES = {}


def pieces(path):
    """This worker's pieces of a model file; tasks share what was learned."""
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def _portions(batch):
    """Slices of a batch (id, text) with a bounded number of texts and characters."""
    first = size = 0
    for at, length in enumerate(pc.utf8_length(batch.column(1)).fill_null(0).to_pylist()):
        size += length
        if at + 1 - first >= _TEXTS or size >= _CHARACTERS:
            yield batch.slice(first, at + 1 - first)
            first, size = at + 1, 0
    if first < batch.num_rows:
        yield batch.slice(first)


def encode(docs, id_col="doc_id", text_col="text", path=None, checked=False):
    """One row (id, ids: array of int) per row of `docs`; a null or empty text has none, an empty table gives no rows.

    With `checked` a column round_trip tells whether the ids decode to the
    text; the model's own mark of a space counts as a space.
    """
    path = path or tokenizer_path(MODEL)
    fields = [docs.select(id_col).schema[0], T.StructField("ids", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([*fields, *([T.StructField("round_trip", T.BooleanType())] if checked else [])])

    def run(batches):
        for batch in batches:
            for part in _portions(batch):
                model, texts = pieces(path), part.column(1).to_pylist()
                ids = model.encode(texts)
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                columns = [part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))]
                if checked:
                    same = [model.decode(i) == (t or "").replace(SPACE, " ") for i, t in zip(ids, texts, strict=True)]
                    columns.append(pa.array(same, pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode(encoded, id_col="doc_id", ids_col="ids", path=None):
    """One row (id, text) per row of `encoded`; null or empty ids give an empty text."""
    path = path or tokenizer_path(MODEL)
    schema = T.StructType([encoded.select(id_col).schema[0], T.StructField("text", T.StringType())])

    def run(batches):
        for batch in batches:
            for part in range(0, batch.num_rows, 128):
                names, lists = batch.slice(part, 128).columns
                values = [np.array(x or [], np.int32) for x in lists.to_pylist()]
                texts = pa.array([pieces(path).decode(v) for v in values], pa.string())
                yield pa.RecordBatch.from_arrays([names, texts], names=[f.name for f in schema])

    return encoded.select(id_col, ids_col).mapInArrow(run, schema)
