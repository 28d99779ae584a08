"""SentencePiece (BPE) encoding with seeded merge-dropout, and decoding.

Encoding works as the library's BPE does: an agenda holds the candidate merges of neighbouring symbols, best
score first and leftmost among equals; each one that comes up is merged, unless a keyed hash of its place
skips it for good. At rate 0 the ids are the library's own. Skips give other, longer segmentations of the same
text, and every one of them decodes to it.

A piece never crosses the start of a run of blanks or a line end, so texts are cut there and cut words are
segmented by themselves. Skips are drawn for each occurrence of a word, from the seed, the document's id and the
word's place in the text: a draw says how many candidates are merged before one is skipped, which is what skipping
each at the rate comes to. Plain segmentations are kept in bounded tables; words in which a candidate is skipped are
merged afresh, many at a time, with the agendas of some thousand words as columns of one matrix. Of long words a hash
skips each candidate, one word at a time. Nothing depends on partitioning or order: reruns, and reruns of lost tasks,
agree.

Defined cases: null and empty texts have no tokens and decode to an empty text; U+2581, the mark that
stands for a blank in pieces, is encoded by its bytes so that it isn't taken for one; characters that no piece has
go by bytes; null ids draw as the text ``None``; repeated rows have equal tokens; very long texts are encoded
whole; other columns are carried or left out as asked, whatever their names.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATE = 0.1
SEED = 29
MARK = "▁"
#: For a MARK of the text itself while its word is segmented; no text holds a lone surrogate.
STAND_IN = "\ud800"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Segmentations after which a worker's tables start anew.
KEPT = 600_000
#: Longer words aren't kept.
LONG = 48
_M = (1 << 64) - 1
_NONE = 1 << 40
_A, _B, _C = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9
_CUT = re.compile(r" *[^ \n]+| +|\n")
#: Before a cut word that is kept as it stands.
_PLAIN = "\0"


def cut(text: str) -> list[str]:
    """The cut words of a text behind its leading blank: those that start with one blank without it, those that start with
    a line end with it, others behind _PLAIN. Most texts have no runs of blanks, and are cut without a pattern."""
    if text[:1] != " " and "  " not in text and _PLAIN not in text:
        return text.replace("\n", " \n").split(" ")
    return [w[1:] if w[0] == " " and w[1:2] not in ("", " ", "\n") and _PLAIN not in w else _PLAIN + w for w in _CUT.findall(" " + text)]


def uncut(word: str) -> str:
    """What a cut word stands for."""
    return word[1:] if word[:1] == _PLAIN else word if word[:1] == "\n" else " " + word


class Pieces:
    """The vocabulary of a model file: merge ranks, byte pieces, and the bytes of each piece."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.bytes: list[bytes] = []
        scores = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.bytes.append(b"")
            else:
                self.ids[piece] = i
                scores[piece] = int(-sp.get_score(i))
                self.bytes.append(piece.replace(MARK, " ").encode())
        self.rank = scores

    def decode(self, ids) -> str:
        """The text; the blank that encoding puts before it is taken off."""
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def _skips(key: int, start: int, size: int, below: int) -> bool:
    """Whether the candidate merge that covers ``size`` characters from ``start`` is left out: 16 bits of its key and
    place, mixed so that places are independent of each other, against the rate."""
    x = (key + start * _A + size * _B) & _M
    x = (x ^ x >> 30) * _C & _M
    x = (x ^ x >> 27) * _A & _M
    return x >> 44 & 0xFFFF < below


def _merged_short(text: str, rank: dict[str, int], below: int, key: int) -> list[str]:
    """The agenda as a list of the scores between neighbours, least first."""
    get, symbols, starts = rank.get, list(text), list(range(len(text)))
    agenda = [get(text[i : i + 2], _NONE) for i in starts[:-1]]
    while agenda:
        best = min(agenda)
        if best == _NONE:
            break
        i = agenda.index(best)
        pair = symbols[i] + symbols[i + 1]
        if _skips(key, starts[i], len(pair), below):
            agenda[i] = _NONE
            continue
        symbols[i] = pair
        del symbols[i + 1], agenda[i], starts[i + 1]
        if i < len(agenda):
            agenda[i] = get(pair + symbols[i + 1], _NONE)
        if i:
            agenda[i - 1] = get(symbols[i - 1] + pair, _NONE)
    return symbols


def _merged_long(text: str, rank: dict[str, int], below: int, key: int) -> list[str]:
    """The agenda as a heap; the same symbols as the list gives, in n log n steps."""
    n = len(text)
    symbols: list[str | None] = list(text)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    agenda = [(r, i, i + 1, text[i : i + 2]) for i in range(n - 1) if (r := rank.get(text[i : i + 2])) is not None]
    heapq.heapify(agenda)
    while agenda:
        _, i, j, pair = heapq.heappop(agenda)
        if symbols[i] is None or symbols[j] is None or after[i] != j or len(symbols[i]) + len(symbols[j]) != len(pair):
            continue  # one of the two has been merged meanwhile
        if _skips(key, i, len(pair), below):
            continue
        symbols[i], symbols[j] = pair, None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := rank.get(pair + symbols[k])) is not None:
                heapq.heappush(agenda, (r, i, k, pair + symbols[k]))
        if (h := before[i]) >= 0 and (r := rank.get(symbols[h] + pair)) is not None:
            heapq.heappush(agenda, (r, h, i, symbols[h] + pair))
    return [s for s in symbols if s is not None]


def _marked(word: str) -> str:
    """A cut word's text with marks for its blanks."""
    return (word.replace(MARK, STAND_IN) if MARK in word else word).replace(" ", MARK)


def _ids(symbols: list[str], pieces: Pieces) -> list[int]:
    try:
        return [pieces.ids[s] for s in symbols]
    except KeyError:
        pass  # some go by bytes
    out: list[int] = []
    for s in symbols:
        if (found := pieces.ids.get(s)) is not None:
            out.append(found)
        else:
            out.extend(pieces.byte_ids[b] for b in (MARK if s == STAND_IN else s).encode())
    return out


def segmented(word: str, pieces: Pieces, rate: float, key: int) -> list[int]:
    """Ids of one cut word, whose blanks are blanks."""
    text = _marked(word)
    merged = _merged_short if len(text) <= 32 else _merged_long
    return _ids(merged(text, pieces.rank, int(rate * (1 << 16)), key), pieces)


class Agendas:
    """Merges many words at once: a row for each word, in which the agenda is the ranks of neighbouring symbols. A symbol is the
    number of its piece, or, for a character without a piece, the number of pieces and its code point."""

    FAR = (1 << 31) - 1

    def __init__(self, pieces: Pieces):
        import numpy as np

        ids, n = pieces.ids, len(pieces.bytes)
        self.first = np.arange(n, n + 0x110000, dtype=np.int32)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.first[ord(piece)] = i
        symbol = lambda x: ids[x] if x in ids else int(self.first[ord(x)]) if len(x) == 1 else None
        found = []
        for piece, i in ids.items():
            for k in range(1, len(piece)):
                if (a := symbol(piece[:k])) is not None and (b := symbol(piece[k:])) is not None:
                    found.append((a << 21 | b, pieces.rank[piece], i))
        table = np.array(sorted(found) or [(-1, 0, 0)], dtype=np.int64)
        self.keys, self.ranks, self.merged = table[:, 0].copy(), table[:, 1].astype(np.int32), table[:, 2].astype(np.int32)

    def pairs(self, left, right):
        """Rank (FAR: no piece) and symbol of neighbours merged."""
        import numpy as np

        key = left.astype(np.int64) << 21 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.FAR), self.merged[at]

    def run(self, texts: list[str], left, draw) -> tuple:
        """(symbols of all texts in a row, how many each has, how many candidates each had). ``left`` says how many
        candidates are merged before one is skipped, and draw(rows, turns) the same for the time after a row's turn-th skip."""
        import numpy as np

        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        flat = self.first[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        starts = np.cumsum(sizes) - sizes
        seen, counts, parts, rows_of = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64), [], []
        for low, high in ((0, 6), (6, 10), (10, 18), (18, 1 << 40)):
            group = np.flatnonzero((sizes > low) & (sizes <= high))
            for at in range(0, len(group), 16_384):
                rows = group[at : at + 16_384]
                width = int(sizes[rows].max())
                cols = np.arange(width + 1)[:, None]
                inside = cols < sizes[rows]
                symbols = np.full(inside.shape, -1, dtype=np.int32)
                symbols[inside] = flat[(starts[rows] + cols)[inside]]
                done = self._merge(symbols, left[rows].copy(), lambda r, t, rows=rows: draw(rows[r], t), seen, rows)
                counts[rows] = (done >= 0).sum(0)
                parts.append(done.T[done.T >= 0])
                rows_of.append(rows)
        order = np.concatenate(rows_of) if rows_of else np.empty(0, dtype=np.int64)
        ends = np.cumsum(counts[order])
        place = np.empty(len(texts), dtype=np.int64)
        place[order] = ends - counts[order]
        return np.concatenate(parts) if parts else np.empty(0, dtype=np.int32), place, counts, seen

    def _merge(self, symbols, left, draw, seen, names):
        """``symbols`` (a column for each word, closed by -1) merged."""
        import numpy as np

        out = np.full_like(symbols, -1)
        rank, made = self.pairs(symbols[:-1], symbols[1:])
        rank[(symbols[1:] < 0) | (symbols[:-1] < 0)] = self.FAR
        rows, turn = np.arange(symbols.shape[1]), np.zeros(symbols.shape[1], dtype=np.int64)
        while True:
            i = rank.argmin(0)
            here = np.arange(len(rows))
            busy = rank[i, here] != self.FAR
            if not busy.all():
                out[: len(symbols), rows[~busy]] = symbols[:, ~busy]
                rows, turn, left, i = rows[busy], turn[busy], left[busy], i[busy]
                symbols, rank, made = symbols[:, busy], rank[:, busy], made[:, busy]
                here = here[: len(rows)]
            if not len(rows):
                return out
            seen[names[rows]] += 1
            skip = left == 0
            left -= 1
            if skip.any():
                s = np.flatnonzero(skip)
                rank[i[s], s] = self.FAR
                turn[s] += 1
                left[s] = draw(rows[s], turn[s])
            k = np.flatnonzero(~skip)
            if not len(k):
                continue
            at = i[k]
            symbols[at, k] = made[at, k]
            cols = np.arange(len(symbols))[:, None]
            take = cols + (cols > np.where(skip, len(symbols), i))
            np.minimum(take, len(symbols) - 1, out=take)
            symbols = np.take_along_axis(symbols, take, 0)
            take = np.minimum(take[:-1], len(rank) - 1)
            rank, made = np.take_along_axis(rank, take, 0), np.take_along_axis(made, take, 0)
            for a, b, ok in ((at, at + 1, symbols[at + 1, k] >= 0), (at - 1, at, at > 0)):
                far = k[~ok & (a >= 0)], a[~ok & (a >= 0)]
                rank[far[1], far[0]] = self.FAR
                a, b, c = a[ok], b[ok], k[ok]
                rank[a, c], made[a, c] = self.pairs(symbols[a, c], symbols[b, c])


class Words(dict):
    """Number of the plain segmentation of a word, kept in bounded tables. By number: ids as bytes of 32-bit numbers, and how many
    candidates came up (none for words that aren't kept)."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces, self.agendas = pieces, Agendas(pieces)
        self.restart()

    def restart(self) -> None:
        import numpy as np

        self.clear()
        self.ids, self.seen = np.empty(1024, dtype=object), np.zeros(1024, dtype=np.int64)

    def learn(self, words: set[str]) -> None:
        import numpy as np

        new = [w for w in words if w not in self]
        n, end = len(self), len(self) + len(new)
        if end > len(self.ids):
            more = max(end, 2 * len(self.ids)) - len(self.ids)
            self.ids = np.concatenate([self.ids, np.empty(more, dtype=object)])
            self.seen = np.concatenate([self.seen, np.zeros(more, dtype=np.int64)])
        short = [w for w in new if len(w) <= LONG]
        ids, seen = self.merged(short, np.full(len(short), 1 << 40), None)
        self.ids[n : n + len(short)], self.seen[n : n + len(short)] = ids, seen
        self.ids[n + len(short) : end], self.seen[n + len(short) : end] = None, 0
        self.update(zip(short, range(n, end)))
        self.update(zip((w for w in new if len(w) > LONG), range(n + len(short), end)))

    def merged(self, words: list[str], left, draw) -> tuple[list[bytes], object]:
        """Ids of each cut word as bytes, and how many candidates came up."""
        texts = [_marked(uncut(w)) for w in words]
        flat, place, counts, seen = self.agendas.run(texts, left, draw)
        raw, n = flat.astype("<i4").tobytes(), len(self.pieces.bytes)
        out = [raw[a:b] for a, b in zip((4 * place).tolist(), (4 * (place + counts)).tolist())]
        # characters without a piece go by bytes
        for i in {*_rows_over(flat, n, place, counts)}:
            symbols = flat[place[i] : place[i] + counts[i]].tolist()
            ids: list[int] = []
            for s in symbols:
                if s < n:
                    ids.append(s)
                else:
                    c = chr(s - n)
                    ids.extend(self.pieces.byte_ids[b] for b in (MARK if c == STAND_IN else c).encode("utf-8", "surrogatepass"))
            out[i] = array("i", ids).tobytes()
        return out, seen


def _rows_over(flat, n: int, place, counts) -> list[int]:
    """Rows in which a symbol is ``n`` or more."""
    import numpy as np

    over = np.flatnonzero(flat >= n)
    if not len(over):
        return []
    some = np.flatnonzero(counts > 0)
    order = some[np.argsort(place[some], kind="stable")]
    return order[np.searchsorted(place[order], over, side="right") - 1].tolist()


class Encoder:
    def __init__(self, model: str = MODEL, rate: float = RATE, seed: int = SEED, kept: int = KEPT):
        self.pieces, self.rate, self.seed, self.kept = Pieces(model), rate, seed, kept
        self.words = Words(self.pieces)

    def _merges(self, keys, places, turns):
        """For words at these places of documents with these keys, how many candidates are merged before the next one
        is skipped; ``turns`` counts the skips so far."""
        import numpy as np

        if self.rate >= 1:
            return np.zeros(len(places), dtype=np.int64)
        x = keys + places.astype(np.uint64) * np.uint64(_A) + turns.astype(np.uint64) * np.uint64(_B)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        return np.minimum(np.log1p(-u) / np.log1p(-self.rate), 1 << 20).astype(np.int64)

    def encode(self, doc_id, text: str | None) -> bytes:
        """Ids as bytes of 32-bit numbers."""
        return self.encode_many([doc_id], [text])[0]

    def encode_many(self, doc_ids: list, texts: list[str | None]) -> list[bytes]:
        import numpy as np
        import xxhash

        table, cuts = self.words, [cut(t) if t else [] for t in texts]
        sizes = [len(c) for c in cuts]
        words = [w for c in cuts for w in c]
        if len(table) >= self.kept:
            table.restart()
        table.learn(set(words))
        node = np.fromiter(map(table.__getitem__, words), dtype=np.int64, count=len(words))
        out = table.ids[node].tolist()
        digests = [xxhash.xxh3_64_intdigest(str(d).encode("utf-8", "surrogatepass"), seed=self.seed & _M) for d in doc_ids]
        keys = np.repeat(np.array(digests, dtype=np.uint64), sizes)
        ends = np.cumsum(sizes)
        places = np.arange(len(words)) - np.repeat(ends - sizes, sizes)
        if self.rate > 0:
            left = self._merges(keys, places, np.zeros(1))
            some = np.flatnonzero(left < table.seen[node])
            drawn, _ = table.merged([words[i] for i in some.tolist()], left[some], lambda r, t: self._merges(keys[some[r]], places[some[r]], t))
            for i, ids in zip(some.tolist(), drawn):
                out[i] = ids
        for i in np.flatnonzero(table.seen[node] == 0).tolist():
            if out[i] is None:
                key = xxhash.xxh3_64_intdigest(words[i].encode("utf-8", "surrogatepass"), seed=(int(keys[i]) + int(places[i]) * _A) & _M)
                out[i] = array("i", segmented(uncut(words[i]), self.pieces, self.rate, key)).tobytes()
        return [b"".join(out[end - size : end]) for size, end in zip(sizes, ends.tolist())]


_encoders: dict[tuple, Encoder] = {}


def _encoder(*args) -> Encoder:
    if args not in _encoders:
        _encoders.clear()
        _encoders[args] = Encoder(*args)
    return _encoders[args]


def _chunks(sizes: list[int | None], rows: int = 256, chars: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of texts of these sizes, of bounded length unless one text alone exceeds it."""
    at = total = 0
    for i, size in enumerate(sizes):
        if i > at and (i - at == rows or total + (size or 0) > chars):
            yield at, i - at
            at, total = i, 0
        total += size or 0
    if at < len(sizes):
        yield at, len(sizes) - at


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, rate: float = RATE, seed: int = SEED, check: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids, and with ``check`` lossless: whether the ids decode to the text."""
    d = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fields = [d.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([*fields, *[T.StructField("lossless", T.BooleanType())] * check])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        enc = _encoder(model, rate, seed)
        for batch in batches:
            for at, n in _chunks(pc.utf8_length(batch.column(1)).to_pylist()):
                names, texts = batch.column(0).slice(at, n), batch.column(1).slice(at, n).to_pylist()
                found = enc.encode_many(names.to_pylist(), texts)
                sizes = np.fromiter((len(x) // 4 for x in found), dtype="<i8", count=len(found))
                flat = np.frombuffer(b"".join(found), dtype="<i4")
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype("<i4")
                columns = [names, pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                if check:
                    columns.append(pa.array([enc.pieces.decode(flat[a:b].tolist()) == (t or "") for a, b, t in zip(ends, ends[1:], texts)]))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return d.mapInArrow(run, schema)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """doc_id, text: what ``encode`` was given (null as an empty text)."""
    d = df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    schema = T.StructType([d.schema["doc_id"], T.StructField("text", T.StringType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pieces = _encoder(model, 0.0, 0).pieces
        for batch in batches:
            texts = pa.array([pieces.decode(x or ()) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=schema.names)

    return d.mapInArrow(run, schema)
