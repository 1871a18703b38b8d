"""SentencePiece BPE models: exact encoding by backtracking, and decoding.

A text is cut into chunks that no piece spans (before a run of spaces, around line ends). A chunk is encoded from left to
right: an Aho-Corasick automaton over reversed pieces gives the longest piece at every place; a piece may follow
another if merging the characters of both anew gives the same two pieces; where none may follow, the last piece is taken back and its end is
marked in a bit field, so that no place fails twice. A sequence whose neighbours are all compatible is the one that merging by score gives.

Models other than BPE with byte fallback, an identity normalizer, a dummy prefix and kept white space are refused.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm._shared import HELD, small_batches, tidied
from tracewell.llm.words import slices

SPACE = "▁"
#: Chunks of at most so many characters are remembered by a worker, and at most so many of them.
REMEMBERED_CHARS, REMEMBERED_CHUNKS = 64, 400_000
#: Pairs of pieces whose compatibility a worker remembers.
REMEMBERED_PAIRS = 1_000_000
#: Bytes of text that are encoded together, and characters of new chunks searched together.
SLICE_BYTES, SEARCH_CHARS = 1_000_000, 1_000_000
#: Runs of so many characters are cut where no longest piece spans.
LONG_RUN = 256
_models: dict[str, PieceModel] = {}


def default_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _raw(chunk: str) -> str:
    return chunk if chunk[0] in (SPACE, "\n") else SPACE + chunk


def _table(items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, items), np.int64, len(items))
    return np.frombuffer(b"".join(items), np.uint8), np.cumsum(lengths) - lengths, lengths


def _gather(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all items one after another, end of each)."""
    flat, start, length = table
    lengths = length[ids]
    ends = np.cumsum(lengths)
    return flat[np.repeat(start[ids] - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)], ends


class PieceModel:
    """Texts -> ids and ids -> texts of one model file."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        normal, trained = proto.normalizer_spec, proto.trainer_spec
        if trained.model_type != trained.BPE or not trained.byte_fallback or normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.add_dummy_prefix or trained.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback, an identity normalizer, a dummy prefix and kept white space")
        model = SentencePieceProcessor(model_proto=proto.SerializeToString())
        n = model.get_piece_size()
        piece = [model.id_to_piece(k) for k in range(n)]
        if any(p.type in (p.USER_DEFINED, p.UNUSED) for p in proto.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        special = {k for k in range(n) if model.is_control(k) or model.is_unknown(k)}
        as_byte = {int(piece[k][3:5], 16): k for k in range(n) if model.is_byte(k)}
        plain = [k for k in range(n) if k not in special and not model.is_byte(k)]
        #: Pieces merge by falling score, those of equal score from left to right.
        level = {s: k for k, s in enumerate(sorted({model.get_score(k) for k in plain}, reverse=True))}
        self.rank = {piece[k]: level[model.get_score(k)] for k in plain}
        self.byte_ids = [as_byte[b] for b in range(256)]
        # characters without a piece of their own still merge into longer ones
        lone = sorted({c for p in self.rank for c in p} - self.rank.keys())
        self.symbols = [piece[k] for k in plain] + lone
        self.ids = [array("i", [k]).tobytes() for k in plain] + [self._bytes_of(c) for c in lone]
        self._learn_merges()
        self.automaton = ahocorasick.Automaton()
        for k in self.place.values():
            self.automaton.add_word(self.symbols[k][::-1], k)
        self.automaton.make_automaton()
        inside = set("".join(self.rank))
        self.gap = next(c for c in map(chr, range(0x110000)) if c not in inside and c != "\n")
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("a piece spans a word's end")
        #: Line ends begin chunks where no piece holds one.
        self.line = "\n" not in inside
        self.chunk = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*" if self.line else f"{SPACE}+[^{SPACE}]*")
        self.release()
        self.numbers = _table([f"{k},".encode() for k in range(n)])
        control = {k for k in range(n) if model.is_control(k)}
        raw = {k: bytes([b]) for b, k in as_byte.items()} | {k: b"" for k in control} | {k: " ⁇ ".encode() for k in special - control}
        self.pieces = _table([raw.get(k, piece[k].replace(SPACE, " ").encode()) for k in range(n)])
        self.spaced = np.fromiter((k not in raw and piece[k].startswith(SPACE) for k in range(n)), bool, n)
        self.bytewise = np.isin(np.arange(n), list(as_byte.values()))
        self.control = np.isin(np.arange(n), list(control))

    def _bytes_of(self, char: str) -> bytes:
        return array("i", [self.byte_ids[b] for b in char.encode()]).tobytes()

    def merged(self, text: str, until: int = 1) -> list[str]:
        """Pieces of a short text by merging its characters, best pair first, at most until so many are left."""
        parts, rank = list(text), self.rank
        while len(parts) > until:
            options = [(r, k) for k in range(len(parts) - 1) if (r := rank.get(parts[k] + parts[k + 1])) is not None]
            if not options:
                break
            _, k = min(options)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _learn_merges(self) -> None:
        """Of every piece that merging can reach: the next shorter one that starts it, and the symbols at its two ends while it is merged, each with
        the rank of the merge that ends it."""
        n, never = len(self.symbols), len(self.rank) + 1
        split: dict[str, tuple[str, str] | None] = {}
        for p in self.symbols:
            parts = self.merged(p, 2)
            if len(p) == 1:
                split[p] = None
            elif len(parts) == 2 and self.merged(p) == [p]:
                split[p] = (parts[0], parts[1])
        place = {p: k for k, p in enumerate(self.symbols) if p in split}
        born = {p: -1 if s is None else self.rank[p] for p, s in split.items()}
        #: Pieces all of whose merges rise strictly in rank; the others (runs of spaces of equal score) are merged anew character by character.
        orderly: set[str] = set()
        for p in sorted(split, key=len):
            s = split[p]
            if SPACE * len(p) != p and (s is None or all(born[x] < born[p] and (x in orderly or x == SPACE) for x in s)):
                orderly.add(p)

        def spine(p: str, side: int) -> list[tuple[int, int]]:
            out, ends = [], never
            while True:
                out.append((place[p], ends))
                if (s := split[p]) is None:
                    return out
                p, ends = s[side], born[p]

        self.place, self.shorter, self.length = place, [-1] * n, [len(p) for p in self.symbols]
        self.first, self.last = [None] * n, [None] * n
        self.joined = {place[s[0]] * n + place[s[1]]: born[p] for p, s in split.items() if s}
        for p, k in place.items():
            self.shorter[k] = next((place[p[:m]] for m in range(len(p) - 1, 0, -1) if p[:m] in place), -1)
            if p in orderly:
                self.first[k], self.last[k] = spine(p, 0), spine(p, 1)

    def _compatible(self, a: int, b: int) -> bool:
        """Whether merging the characters of both gives the same two pieces: no symbol at the end of a may meet one at the start of b and merge with
        it before either is merged within its own piece (of equal ranks the left comes first)."""
        tails, heads, n = self.last[a], self.first[b], len(self.symbols)
        if tails is None or heads is None:
            return self.merged(self.symbols[a] + self.symbols[b]) == [self.symbols[a], self.symbols[b]]
        for x, ends_x in tails:
            for y, ends_y in heads:
                rank = self.joined.get(x * n + y)
                if rank is not None and rank < ends_x and rank <= ends_y:
                    return False
        return True

    def _backtrack(self, longest: list[int], begin: int, end: int) -> list[int]:
        """Pieces of the places begin..end, every one of which has a longest piece."""
        shorter, length, pairs, n = self.shorter, self.length, self.pairs, len(self.symbols)
        out: list[int] = []
        failed = bytearray((end - begin) // 8 + 1)  # bit k: no sequence ends at begin + k
        at, piece, before = begin, longest[begin], -1
        while at < end:
            while piece >= 0:
                stop = at + length[piece]
                if stop <= end and not failed[(stop - begin) >> 3] >> (stop - begin & 7) & 1:
                    if before < 0:
                        break
                    key = before * n + piece
                    fits = pairs.get(key)
                    if fits is None:
                        fits = pairs[key] = self._compatible(before, piece)
                    if fits:
                        break
                piece = shorter[piece]
            if piece >= 0:
                out.append(piece)
                at, before = stop, piece
                piece = longest[at] if at < end else -1
            else:
                failed[(at - begin) >> 3] |= 1 << (at - begin & 7)
                piece = out.pop()
                at -= length[piece]
                before = out[-1] if out else -1
        return out

    def _encode_chunks(self, chunks: list[str]) -> Iterator[bytes]:
        """Ids of each chunk."""
        text = self.gap.join(chunks)
        longest = [-1] * (len(text) + 1)
        last = len(text) - 1
        for stop, piece in self.automaton.iter(text[::-1]):  # at each place the longest comes first
            if longest[last - stop] < 0:
                longest[last - stop] = piece
        begin, code = 0, self.ids
        for chunk in chunks:
            end = begin + len(chunk)
            if end - begin <= LONG_RUN and -1 not in longest[begin:end]:
                yield b"".join([code[piece] for piece in self._backtrack(longest, begin, end)])
            else:
                yield b"".join(self._runs(text, longest, begin, end))
            begin = end + 1

    def _runs(self, text: str, longest: list[int], at: int, end: int) -> Iterator[bytes]:
        """Ids of the parts of a chunk: a character of no piece parts what is before it from what follows, and long runs are cut where no piece spans, so
        that the bit field stays short."""
        while at < end:
            if longest[at] < 0:
                yield self._bytes_of(text[at])
                at += 1
                continue
            stop = reach = at
            while stop < end and longest[stop] >= 0 and (stop == at or stop < reach or stop - at < LONG_RUN):
                reach = max(reach, stop + self.length[longest[stop]])
                stop += 1
            for piece in self._backtrack(longest, at, stop):
                yield self.ids[piece]
            at = stop

    def _cut(self, text: str) -> list[str]:
        """Chunks; one that begins with a single space is given without it, all others as they are."""
        if not text:
            return []
        text = text.replace(SPACE, " ")
        if text[0] not in " \n" and text[-1] != " " and "  " not in text:
            return (text.replace("\n", " \n") if self.line else text).split(" ") if " \n" not in text else self._cut_slowly(text)
        return self._cut_slowly(text)

    def _cut_slowly(self, text: str) -> list[str]:
        return [c[1:] if c[0] == SPACE and c[1:2] not in ("", SPACE) else c for c in self.chunk.findall(SPACE + text.replace(" ", SPACE))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """32-bit ids of every text."""
        cut = [self._cut(t) for t in texts]
        found = [list(map(self.known.get, chunks)) for chunks in cut]
        wanted = {c for chunks, ids in zip(cut, found, strict=True) if None in ids for c, x in zip(chunks, ids, strict=True) if x is None}
        if not wanted:
            return [np.frombuffer(b"".join(x), np.int32) for x in found]
        if len(self.known) > REMEMBERED_CHUNKS:
            self.known, self.older = {}, self.known
        if len(self.pairs) > REMEMBERED_PAIRS:
            self.pairs = {}
        own: dict[str, bytes] = {}
        new, held = [], 0
        for chunk in wanted:
            ids = self.older.get(chunk)
            if ids is not None:
                own[chunk] = ids
                continue
            new.append(chunk)
            held += len(chunk)
            if held > SEARCH_CHARS:
                own.update(zip(new, self._encode_chunks([_raw(c) for c in new]), strict=True))
                new, held = [], 0
        own.update(zip(new, self._encode_chunks([_raw(c) for c in new]), strict=True))
        self.known.update((c, x) for c, x in own.items() if len(c) <= REMEMBERED_CHARS)
        return [np.frombuffer(b"".join([own[c] if x is None else x for c, x in zip(chunks, ids, strict=True)] if None in ids else ids), np.int32) for chunks, ids in zip(cut, found, strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the dummy prefix goes, bytes that are no UTF-8 become U+FFFD each."""
        shown = np.flatnonzero(~self.control[ids])
        data, ends = _gather(self.pieces, ids)
        skip = int(len(shown) > 0 and bool(self.spaced[ids[shown[0]]]))
        try:
            return data.tobytes()[skip:].decode()
        except UnicodeDecodeError:
            pass
        out, raw, begin = [], data.tobytes(), np.concatenate(([0], ends))
        turns = np.flatnonzero(np.diff(self.bytewise[ids].astype(np.int8), prepend=-1, append=-1))
        for a, b in zip(turns[:-1].tolist(), turns[1:].tolist(), strict=True):
            part = raw[begin[a] : begin[b]]
            out.append(_lenient(part) if self.bytewise[ids[a]] else part.decode())
        return "".join(out)[skip:]

    def release(self) -> None:
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}


def _lenient(raw: bytes) -> str:
    """UTF-8 in which every byte that starts no character becomes U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        size = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
        try:
            out.append(raw[at : at + size].decode())
            at += size
        except UnicodeDecodeError:
            out.append("�")
            at += 1
    return "".join(out)


def piece_model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def _forget() -> None:
    for model in _models.values():
        model.release()


HELD["pieces"] = _forget


def encode_texts(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, text -> doc_id, ids (array<int>), without begin or end ids; null and empty texts have none, texts are encoded whole. Rows are
    independent: repeated and null ids stay as they are, other columns are not read, an empty table gives no rows."""
    small_batches(docs.sparkSession)
    kind = pa.list_(pa.int32())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path or default_model_path())
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                ids = model.encode(part.column("text").fill_null("").to_pylist())
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                values = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), values).cast(kind)], ["doc_id", "ids"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidied(run, "pieces"), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def _id_arrays(column: pa.Array) -> Iterator[np.ndarray]:
    ends = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    for a, b, there in zip(ends[:-1].tolist(), ends[1:].tolist(), column.is_valid().to_pylist(), strict=True):
        yield values[a:b] if there else values[:0]


def decode_ids(encoded: DataFrame, model_path: str | None = None, digests: bool = False) -> DataFrame:
    """doc_id, ids -> doc_id, text; or, with digests, doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256. Null ids count as none."""
    small_batches(encoded.sparkSession)
    key = f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path or default_model_path())
        for batch in batches:
            rows = list(_id_arrays(batch.column("ids")))
            texts = [model.decode(ids) for ids in rows]
            if not digests:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])
                continue
            shown = [hashlib.sha256(_gather(model.numbers, ids)[0][:-1].tobytes()).hexdigest() for ids in rows]
            back = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
            columns = [batch.column("doc_id"), pa.array(map(len, rows), pa.int64()), pa.array(shown, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"{key}, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else f"{key}, text string"
    return encoded.select("doc_id", "ids").mapInArrow(tidied(run, "pieces"), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_ids(encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")), digests=True)
