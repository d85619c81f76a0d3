"""Byte-level BPE by a lazily determinised finite-state transducer.

Merges are compiled into the trie of token bytes and one relation: token b may follow
token a iff encoding their joined bytes gives a, b back. The encoding of a prefix is then
the encoding of a shorter prefix and one last token: of the tokens that end it, the one
that may follow what stands before. A later token can reach back to any place within the
longest trie path that ends here, so all encodings up to those places are still possible:
that set, each with the tokens it has beyond what all share, is a state. States and arcs
are made when first met (subset construction with residual output) and kept in a bounded
table. Tokens that all possibilities share are emitted at once, so the lookahead is
bounded by the longest token. Decoding joins token bytes and runs them through an
incremental UTF-8 state machine.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import freed, read_table

#: Arcs and bytes of pieces that one worker keeps at most; past that its table starts afresh.
#: Longer pieces than LONG are not kept.
MAX_ARCS, MAX_BYTES, LONG = 500_000, 6 << 20, 256
_START = -1


class Transducer:
    """Encodes by a table of ranks, {token bytes: id}, that holds all single bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        #: byte strings that begin a token
        self.paths = {b[:n] for b in ranks for n in range(1, len(b) + 1)}
        self.split: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[int, bool] = {}
        self._fresh()

    def _fresh(self) -> None:
        """A state: the bytes that a later token can reach back over, and for the place
        before each of them and after the last: the last token, and tokens not yet
        emitted; None where no token can reach back to."""
        first = (b"", ((_START, ()),))
        self.pool: dict[tuple, tuple] = {}
        self.states, self.number = [first], {first: 0}
        #: for each state: by byte, the arcs of the next state and the tokens settled; its number by -1
        self.arcs: list[dict[int, tuple]] = [{-1: 0}]
        self.made = 0

    def _merged(self, piece: bytes, below: int = 1 << 60) -> list[int]:
        """Merging by rank, as the vocabulary defines it, with ranks under ``below``."""
        ranks, parts = self.ranks, [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if token not in self.split:
            whole = self.bytes[token]
            made = self._merged(whole, token) if len(whole) > 1 else []
            self.split[token] = (made[0], made[1]) if len(made) == 2 else None
        return self.split[token]

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether a, b are the encoding of their joined bytes."""
        if a == _START:
            return True
        key = a << 20 | b
        if key not in self.fits:
            if len(self.fits) > MAX_ARCS:
                self.fits.clear()
            self.fits[key] = self._fit(a, b)
        return self.fits[key]

    def _fit(self, a: int, b: int) -> bool:
        """Undoes the merges next to the border, the latest first. If at some point the two
        tokens at the border would have merged before the merge last undone, then merging
        would have crossed the border."""
        left, right, before = a, b, (1 << 60, 0)
        while True:
            across = self.ranks.get(self.bytes[left] + self.bytes[right])
            # Of equal ranks the leftmost merges first: one that ends on the right side
            # comes after one across the border, one on the left side before it.
            if across is not None and (across, 1) < before:
                return False
            l, r = self._halves(left), self._halves(right)
            if l is None and r is None:
                return True
            if r is None or (l is not None and left > right):
                before, left = (left, 0), l[1]
            else:
                before, right = (right, 2), r[0]

    def _arc(self, here: dict[int, tuple], byte: int) -> tuple[dict[int, tuple], tuple[int, ...]]:
        window, places = self.states[here[-1]]
        window += bytes((byte,))
        ranks, paths, pool = self.ranks, self.paths, self.pool
        for i, place in enumerate(places):
            if place is not None:
                token = ranks.get(window[i:])
                if token is not None and self._may_follow(place[0], token):
                    break
        else:
            raise ValueError("the vocabulary does not hold every single byte")
        # A place stays open while what follows it can still become a token.
        still = [p if p is not None and window[i:] in paths else None for i, p in enumerate(places)]
        still.append((token, (*place[1], token)))
        keep = next(i for i, p in enumerate(still) if p is not None)
        window, still = window[keep:], still[keep:]
        pending = [p[1] for p in still if p is not None]
        low, high = min(pending), max(pending)
        settled = 0
        while settled < len(low) and low[settled] == high[settled]:
            settled += 1
        target = (window, tuple([p if p is None else pool.setdefault(q := (p[0], p[1][settled:]), q) for p in still]))
        number = self.number.get(target)
        if number is None:
            number = self.number[target] = len(self.states)
            self.states.append(target)
            self.arcs.append({-1: number})
        self.made += 1
        here[byte] = made = self.arcs[number], pool.setdefault(q := low[:settled], q)
        return made

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one match of the splitting pattern."""
        if self.made > MAX_ARCS:
            self._fresh()
        here, ids = self.arcs[0], []
        for byte in piece:
            arc = here.get(byte)
            if arc is None:
                arc = self._arc(here, byte)
            here, settled = arc
            if settled:
                ids += settled
        ids += self.states[here[-1]][1][-1][1]
        return ids


class _Pieces(dict):
    """Ids of pieces, made when first asked for; what was used before stays at hand."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer
        self.before: dict[str, bytes] = {}
        self.held = 0

    def __missing__(self, piece: str) -> bytes:
        made = self.before.get(piece)
        if made is None:
            made = array("I", self.transducer.encode_piece(piece.encode())).tobytes()
        if len(piece) <= LONG:
            if self.held > MAX_BYTES:
                self.before, self.held = dict(self), 0
                self.clear()
            self.held += len(piece) + len(made)
            self[piece] = made
        return made


class Splitter:
    """The matches of a pattern in a text, by the character classes of tiktoken's engine.

    Unicode versions differ between engines. A character that this one puts into other
    classes is replaced by one that both put where tiktoken has it; the text is split with
    that stand-in, and the pieces are taken from the text itself.
    """

    def __init__(self, pattern: str):
        import tiktoken

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        single = {bytes((i,)): i for i in range(256)}
        classes = sorted(set(regex.findall(r"\\p\{\^?\w+\}|\\s", pattern)))
        there, here = [], []
        for name in classes:
            # What a pattern does not match is left out, so this gives the class's members.
            probe = tiktoken.Encoding("probe", pat_str=f"{name}+", mergeable_ranks=single, special_tokens={})
            there.append(set(bytes(probe.encode_ordinary(every)).decode()))
            here.append(set("".join(regex.findall(f"{name}+", every))))
        odd = sorted(set().union(*[a ^ b for a, b in zip(there, here, strict=True)])) if classes else []
        kind = lambda c, table: tuple(c in x for x in table)
        some = {kind(c, there): c for c in reversed("aé9²\u00a0!§") if kind(c, there) == kind(c, here)}
        self.stand_in = {ord(c): some[kind(c, there)] for c in odd}
        # A set: the engine tries the members of so large a character class one by one.
        self.odd = frozenset(odd)
        self.findall, self.finditer = regex.compile(pattern).findall, regex.compile(pattern).finditer

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or self.odd.isdisjoint(text):
            return self.findall(text)
        return [text[m.start() : m.end()] for m in self.finditer(text.translate(self.stand_in))]


class Codec:
    """Encodes whole texts by pattern and ranks, and decodes ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split = Splitter(pattern)
        self.transducer = Transducer(ranks)
        self.pieces = _Pieces(self.transducer)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode(self, ids: Iterable[int]) -> bytes:
        table = self.transducer.bytes
        return b"".join([table[i] for i in ids])


class Utf8Stream:
    """An incremental UTF-8 state machine: bytes in any cuts, whole characters out.

    The state is the unfinished character, at most three bytes. Bytes that cannot belong
    to a character become U+FFFD.
    """

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 != 0x80:
                need = 2 if lead & 0xE0 == 0xC0 else 3 if lead & 0xF0 == 0xE0 else 4 if lead & 0xF8 == 0xF0 else 1
                cut = len(data) - back if need > back else len(data)
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file with lines of base64 token and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for a worker; its tables serve all tasks that the worker gets."""
    return Codec(load_ranks(path), pattern)


def decode_stream(codec_: Codec, ids: np.ndarray, step: int = 4096) -> Iterator[str]:
    """The text of ids, ``step`` ids at a time."""
    machine = Utf8Stream()
    for i in range(0, len(ids), step):
        yield machine.feed(codec_.decode(ids[i : i + step].tolist()))
    yield machine.close()


def round_trip(documents: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encode each text and decode the ids: doc_id, n_tokens, ids_sha256,
    decoded_sha256, and the ids themselves if asked for.

    A null text is an empty one: no tokens. The vocabulary's file is read on each
    executor, which needs it under the same path. Further columns are ignored; an empty
    table gives an empty result.
    """

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for text in part.column("text").to_pylist():
                    raw = c.encode(text or "")
                    ids = np.frombuffer(raw, dtype="<u4")
                    back = hashlib.sha256()
                    for some in decode_stream(c, ids):
                        back.update(some.encode())
                    rows.append((len(ids), hashlib.sha256(raw).hexdigest(), back.hexdigest(), ids if with_ids else None))
                n, sha, decoded, ids = zip(*rows, strict=True)
                out = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha), pa.array(decoded)]
                if with_ids:
                    out.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    kind = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, kind)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return round_trip(read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
