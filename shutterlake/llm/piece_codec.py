"""SentencePiece merge-type (BPE) encoding and decoding.

Encoding is exact without running the merges over the text. A token sequence is the
BPE result if and only if each token re-merges to itself and each adjacent pair
re-merges to that pair: merges happen in one fixed order (score, then place), so a
merge across a boundary of the whole text would also happen in the pair alone. So a
segment is encoded by backtracking over the vocabulary's matches, longest first; a
bitfield keeps the positions that were tried and can't be completed, which bounds the
work. Where no piece holds two neighbouring characters (a letter and then a space, say)
a text falls into independent segments; each distinct segment is encoded once.

Edge cases: a null or empty text has no pieces (only the begin and end ids if they are
asked for); characters outside the vocabulary become byte pieces; repeated rows give
repeated results; an empty table gives an empty result; an existing column of an
output's name is replaced.
"""

from __future__ import annotations

import itertools

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shutterlake.llm.text_arrays import map_slices, mix, raw

SPACE = "▁"
#: Between segments that are matched in one pass; no piece may hold it.
GAP = "\U0010fffd"
#: Slots of the table of known pairs, which is emptied when half full: relearning the common
#: ones is little against the pairs that filled it.
SLOTS = 1 << 21
#: Segments that a worker keeps with their ids, none longer than so many bytes.
CACHED, CACHED_BYTES = 1 << 18, 64
#: Segments that are backtracked together; the few that take longer end one by one.
TOGETHER = 32


class PairTable:
    """What is known of numbered pairs: an open-addressing table in one array."""

    EMPTY = np.uint64(2**64 - 1)

    def __init__(self):
        self.slots, self.held = np.full(SLOTS, self.EMPTY), 0

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) & np.uint64(SLOTS - 1)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """1: fits, 0: doesn't, -1: unknown."""
        out, at = np.full(len(keys), -1, np.int8), self._first(keys)
        open_ = np.arange(len(keys))
        while len(open_):
            seen = self.slots[at[open_]]
            mine = seen >> np.uint64(1) == keys[open_]
            out[open_[mine]] = (seen[mine] & np.uint64(1)).astype(np.int8)
            open_ = open_[~mine & (seen != self.EMPTY)]
            at[open_] = (at[open_] + 1) & (SLOTS - 1)
        return out

    def put(self, keys: np.ndarray, fits: np.ndarray) -> None:
        """Distinct keys that are not held yet."""
        if self.held + len(keys) > SLOTS // 2:
            self.slots[:], self.held = self.EMPTY, 0
        entry, at, open_ = keys << np.uint64(1) | fits.astype(np.uint64), self._first(keys), np.arange(len(keys))
        while len(open_):
            free = open_[self.slots[at[open_]] == self.EMPTY]
            self.slots[at[free]] = entry[free]  # of those that meet in a slot one stays
            open_ = open_[self.slots[at[open_]] != entry[open_]]
            at[open_] = (at[open_] + 1) & (SLOTS - 1)
        self.held += len(keys)


class PieceModel:
    """Lookup tables of one serialized model. Pieces are kept with plain spaces."""

    def __init__(self, proto: bytes):
        lib = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.bos, self.eos = lib.bos_id(), lib.eos_id()
        self.score, self.ids, self.surface = {}, {}, []
        self.byte_ids = [0] * 256
        self.size = np.zeros(lib.vocab_size(), np.int64)
        self.is_byte = np.zeros(lib.vocab_size(), bool)
        self.spaced = np.zeros(lib.vocab_size(), bool)
        self.silent = np.zeros(lib.vocab_size(), bool)
        self.piece = [""] * lib.vocab_size()
        self.matches = ahocorasick.Automaton()
        for i in range(lib.vocab_size()):
            piece = lib.id_to_piece(i)
            if lib.is_control(i):
                self.surface.append(b"")
                self.silent[i] = True
            elif lib.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte_ids[value] = i
                self.is_byte[i] = True
                self.surface.append(bytes([value]))
            elif lib.is_unknown(i):
                self.surface.append(lib.decode([i]).encode())
            else:
                self.spaced[i] = piece.startswith(SPACE)
                piece = piece.replace(SPACE, " ")
                self.score[piece], self.ids[piece] = lib.get_score(i), i
                self.piece[i], self.size[i] = piece, len(piece)
                self.surface.append(piece.encode())
                self.matches.add_word(piece, i)
        self.matches.make_automaton()
        if any(GAP in piece for piece in self.ids):
            raise ValueError("a piece holds the separator of segments")
        # A second row of surfaces, without the space that a text's first piece loses.
        bare = [s[1:] if spaced else s for s, spaced in zip(self.surface, self.spaced, strict=True)]
        self.surface = pa.array(self.surface + bare, pa.binary())
        # Two neighbours that no piece holds are never in one token: texts are cut there.
        self.cut = np.zeros((256, 256), bool)
        self.cut[:128, :128] = True
        self.cut[128:, 32] = True
        for piece in self.ids:
            for x, y in zip(piece, piece[1:]):
                self.cut[min(ord(x), 128), min(ord(y), 128)] = False
                if ord(x) > 127 and y == " ":
                    self.cut[128:, 32] = False
        self.pairs = PairTable()
        self.known = self.known_ids = pa.array([], pa.binary())
        self.used = np.zeros(0, bool)

    def merged(self, text: str) -> list[str]:
        """The plain merges over a short text: best score first, then the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def remerged(self, left: str, right: str) -> bool:
        """Whether the tokens stay as they are when their joined text is merged anew."""
        return self.merged(left + right) == [x for x in (left, right) if x]

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The same for arrays of ids; a left id 0, which is no piece's, stands for nothing."""
        keys = left.astype(np.uint64) * np.uint64(len(self.size)) + right.astype(np.uint64)
        fits = self.pairs.get(keys)
        unknown = np.flatnonzero(fits < 0)
        if len(unknown):
            fresh, place = np.unique(keys[unknown], return_inverse=True)
            pairs = [divmod(k, len(self.size)) for k in fresh.tolist()]
            told = np.array([self.remerged(self.piece[x], self.piece[y]) for x, y in pairs], bool)
            fits[unknown] = told[place]
            for i in range(0, len(fresh), SLOTS // 4):
                self.pairs.put(fresh[i : i + SLOTS // 4], told[i : i + SLOTS // 4])
        return fits == 1

    def tokens(self, text: str) -> list[str]:
        """Tokens of one segment, by backtracking from the longest matches."""
        n, piece = len(text), self.piece
        known: dict[tuple[str, str], bool] = {}
        ends: list[list[int]] = [[] for _ in range(n)]
        for last, i in self.matches.iter(text):
            ends[last + 1 - len(piece[i])].append(last + 1)
        failed = bytearray((n >> 3) + 1)
        chosen: list[tuple[int, int, str]] = []
        at, before, option, token = 0, "", None, ""
        while at < n:
            here = ends[at]
            if option is None:
                if not here or here[0] != at + 1:
                    here.insert(0, at + 1)  # a character outside the vocabulary
                option = len(here) - 1
            while option >= 0:
                end = here[option]
                if not failed[end >> 3] >> (end & 7) & 1:
                    token = text[at:end]
                    fits = known.get((before, token))
                    if fits is None:
                        fits = known[before, token] = self.remerged(before, token)
                    if fits:
                        break
                option -= 1
            if option >= 0:
                chosen.append((at, option, token))
                before, at, option = token, end, None
            else:
                failed[at >> 3] |= 1 << (at & 7)
                at, option, _ = chosen.pop()
                option -= 1
                before = chosen[-1][2] if chosen else ""
        return [x[2] for x in chosen]

    def token_ids(self, segment: str) -> list[int]:
        out: list[int] = []
        for token in self.tokens(segment):
            i = self.ids.get(token)
            if i is None:
                out.extend(self.byte_ids[b] for b in token.encode())
            else:
                out.append(i)
        return out

    def descend(self, text: str, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The backtracking's first descent for all segments at once: ids of the longest
        matches from the left, how many each segment has, and whether they are its tokens,
        which is so if they cover it and all neighbours are compatible."""
        found = np.fromiter(itertools.chain.from_iterable(self.matches.iter_long(text)), np.int64).reshape(-1, 2)
        ids = found[:, 1]
        of = np.searchsorted(start, found[:, 0], side="right") - 1
        whole = np.bincount(of, self.size[ids], len(start)) == size
        fits = self.compatible(np.where(np.diff(of, prepend=-1) == 0, np.roll(ids, 1), 0), ids)
        return ids, np.bincount(of, minlength=len(start)), whole & (np.bincount(of[~fits], minlength=len(start)) == 0)

    def backtrack(self, text: str, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and their number for each segment, and whether it came to its end: the steps
        of ``tokens`` for all segments at once. The tokens before a place are the encoding
        of what is before it, so a place has one token before it at most, and its options
        are tried once."""
        found = np.fromiter(itertools.chain.from_iterable(self.matches.iter(text)), np.int64).reshape(-1, 2)
        found = found[np.lexsort((self.size[found[:, 1]], found[:, 0] + 1 - self.size[found[:, 1]]))]
        ids, end = found[:, 1], found[:, 0] + 1
        begin = end - self.size[ids]
        first = np.searchsorted(begin, np.arange(len(text) + 1))
        option = np.append(first[1:], len(ids)) - 1  # the next match to try at each place, from the longest
        single = np.zeros(len(text) + 1, bool)
        single[begin[self.size[ids] == 1]] = True
        of_place = np.repeat(np.arange(len(start)), size)
        inside = start[of_place] + np.arange(len(of_place)) - np.repeat(np.cumsum(size) - size, size)
        odd = np.bincount(of_place[~single[inside]], minlength=len(start)) > 0  # characters outside the vocabulary
        failed = np.zeros(len(text) + 1, bool)
        behind = np.full(len(text) + 1, -1)  # the match that ends at a place
        live, stop, done = np.flatnonzero(~odd), start + size, np.zeros(len(start), bool)
        at = start.copy()
        while len(live) > TOGETHER:
            here = at[live]
            tried = option[here]
            has = tried >= first[here]
            ok = has.copy()
            ok[has] = ~failed[end[tried[has]]]
            last = behind[here[ok]]
            ok[ok] = self.compatible(np.where(last < 0, 0, ids[last]), ids[tried[ok]])
            behind[end[tried[ok]]] = tried[ok]
            at[live[ok]] = end[tried[ok]]
            option[here[has & ~ok]] -= 1
            lost = here[~has]
            failed[lost] = True
            back = begin[behind[lost]]
            at[live[~has]] = back
            option[back] -= 1
            over = at[live] == stop[live]
            done[live[over]] = True
            live = live[~over]
        # The chosen matches, from the ends.
        chosen, owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        live, at = np.flatnonzero(done), stop.copy()
        while len(live):
            last = behind[at[live]]
            chosen.append(last)
            owner.append(live)
            at[live] = begin[last]
            live = live[at[live] > start[live]]
        chosen, owner = np.concatenate(chosen), np.concatenate(owner)
        order = np.lexsort((begin[chosen], owner))
        return ids[chosen[order]], np.bincount(owner, minlength=len(start)), done

    def fresh_ids(self, segments: pa.Array) -> pa.Array:
        """Packed ids of distinct segments."""
        size = pc.utf8_length(segments.cast(pa.string())).to_numpy().astype(np.int64)
        ids = [np.zeros(0, np.int64)]
        owner = [np.zeros(0, np.int64)]
        left = np.arange(len(size))
        for attempt in (self.descend, self.backtrack):
            if len(left):
                text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(left)], pa.int32()), segments.take(pa.array(left))), GAP.encode())[0].as_py().decode()
                own, count, done = attempt(text, np.cumsum(size[left] + 1) - size[left] - 1, size[left])
                ids.append(own[np.repeat(done, count)])
                owner.append(np.repeat(left[done], count[done]))
                left = left[~done]
        for k in left.tolist():
            own = self.token_ids(segments[k].as_py().decode())
            ids.append(np.array(own))
            owner.append(np.full(len(own), k))
        owner = np.concatenate(owner)
        n = np.bincount(owner, minlength=len(size))
        order = np.argsort(owner, kind="stable")
        return _binary(np.concatenate(ids)[order].astype("<u4"), np.concatenate([[0], np.cumsum(n)]))

    def segment_ids(self, segments: pa.Array) -> pa.Array:
        """Packed ids of distinct segments, known ones from the cache. A full cache keeps
        what was asked for since it last was full."""
        place = pc.index_in(segments, value_set=self.known)
        miss = place.is_null().to_numpy(zero_copy_only=False)
        at = place.fill_null(0).to_numpy().astype(np.int64)
        self.used[at[~miss]] = True
        fresh = segments.filter(pa.array(miss))
        ids = pa.concat_arrays([self.known_ids, self.fresh_ids(fresh)])
        at[miss] = len(self.known) + np.arange(len(fresh))
        out = ids.take(pa.array(at))
        short = np.diff(raw(fresh)[1]) <= CACHED_BYTES
        keep = np.concatenate([np.ones(len(self.known), bool), short])
        used = np.concatenate([self.used, np.zeros(len(fresh), bool)])
        if keep.sum() > CACHED:
            keep[: len(self.known)] = self.used if 2 * self.used.sum() <= CACHED else False
            used[:] = False
        chosen = pa.array(keep)
        self.known, self.known_ids, self.used = pa.concat_arrays([self.known, fresh]).filter(chosen), ids.filter(chosen), used[keep]
        return out


    def encode(self, column: pa.Array, ends: bool) -> pa.Array:
        """Packed ids (little-endian unsigned 32-bit) of each text."""
        text, at = raw(pc.replace_substring(column, SPACE, " "))  # the model holds both as one character
        rows = len(at) - 1
        # The dummy space before each text that isn't empty.
        filled = np.diff(at) > 0
        moved = at + np.concatenate([[0], np.cumsum(filled)])
        data = np.full(len(text) + int(filled.sum()), 32, np.uint8)
        put = np.ones(len(data), bool)
        put[moved[:-1][filled]] = False
        data[put] = text
        begin = np.zeros(len(data) + 1, bool)
        if len(data):
            begin[1:-1] = self.cut[data[:-1], data[1:]]
        begin[moved] = True
        cuts = np.flatnonzero(begin).astype(np.int32)
        segments = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)])
        coded = segments.dictionary_encode()
        out = self.segment_ids(coded.dictionary).take(coded.indices)
        ids, where = raw(out)
        ids, where = np.frombuffer(ids.tobytes(), "<u4"), where[np.searchsorted(cuts, moved)] // 4
        if not ends:
            return _binary(ids, where)
        held = np.empty(len(ids) + 2 * rows, "<u4")
        begin_at = where + 2 * np.arange(rows + 1)
        mark = np.ones(len(held), bool)
        mark[begin_at[:-1]] = mark[begin_at[1:] - 1] = False
        held[mark] = ids
        held[begin_at[:-1]], held[begin_at[1:] - 1] = self.bos, self.eos
        return _binary(held, begin_at)

    def decode(self, column: pa.Array) -> pa.Array:
        """Texts of packed ids, as the library's decode gives them."""
        packed, at = raw(column)
        ids, at = np.frombuffer(packed.tobytes(), "<u4"), at // 4
        spoken = np.flatnonzero(~self.silent[ids])
        first = np.searchsorted(spoken, at[:-1])
        has = np.append(spoken, len(ids))[first] < at[1:]
        shown = ids.astype(np.int64)
        shown[spoken[first[has]]] += len(self.silent)
        out = pc.binary_join(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), self.surface.take(pa.array(shown))), b"")
        mute = np.flatnonzero(self.silent[ids[1:-1]]) + 1
        try:
            if (self.is_byte[ids[mute - 1]] & self.is_byte[ids[mute + 1]]).any():  # a control id ends a run of bytes
                raise pa.ArrowInvalid
            return out.cast(pa.string())
        except pa.ArrowInvalid:  # byte pieces that are no UTF-8
            return pa.array([self._spoken(shown[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())

    def _spoken(self, shown: np.ndarray) -> str:
        out, held = [], b""
        for i in [*shown.tolist(), -1]:
            if i >= 0 and self.is_byte[i % len(self.is_byte)]:
                held += self.surface[i].as_py()
                continue
            while held:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(held[:n].decode())
                        held = held[n:]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    held = held[1:]
            if i >= 0:
                out.append(self.surface[i].as_py().decode())
        return "".join(out)


def _binary(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Packed ids, whose rows' offsets count ids."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((4 * offsets).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids))])


_MODELS: dict[int, PieceModel] = {}


def _model(shared) -> PieceModel:
    """One model, with its caches, for all tasks of a Python worker."""
    proto = shared.value
    if hash(proto) not in _MODELS:
        _MODELS.clear()
        _MODELS[hash(proto)] = PieceModel(proto)
    return _MODELS[hash(proto)]


def _shared(df: DataFrame, model_path: str):
    """The model's bytes (a vocabulary, so of fixed size) for all executors."""
    with open(model_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_pieces(df: DataFrame, model_path: str, text: str = "text", out: str = "ids", begin_end: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Append ``out``: packed little-endian unsigned 32-bit ids of each whole text."""
    shared = _shared(df, model_path)

    def make():
        model = _model(shared)
        return lambda column: [model.encode(column, begin_end)]

    return map_slices(df, text, [(out, T.BinaryType())], make, keep)


def decode_pieces(df: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Append ``out``: the text that packed ids stand for."""
    shared = _shared(df, model_path)

    def make():
        model = _model(shared)
        return lambda column: [model.decode(column)]

    return map_slices(df, ids, [(out, T.StringType())], make, keep)


def code_pieces(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", begin_end: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Append ``ids`` as encode_pieces does, and ``decoded``, the text that these ids stand for. One Python
    worker does both: in two steps each core holds two, and both keep a model as long as they live."""
    shared = _shared(df, model_path)

    def make():
        model = _model(shared)

        def code(column: pa.Array) -> list[pa.Array]:
            packed = model.encode(column, begin_end)
            return [packed, model.decode(packed)]

        return code

    return map_slices(df, text, [(ids, T.BinaryType()), (decoded, T.StringType())], make, keep)


def token_digest(df: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document."""
    back = code_pieces(df.select("doc_id", "text"), model_path, keep=["doc_id"])
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
