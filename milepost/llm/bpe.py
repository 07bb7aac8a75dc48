"""BPE encoding and decoding (operator 10) as streaming transducers.

Encoding: text enters in chunks. It is normalised, cut into pieces as the
vocabulary's rules say, and each piece is merged by rank. A piece that is
longer than the window is not held: ``lookahead`` computes from the merge list
how far to the left a symbol not yet seen can change the outcome; boundaries
further away are stable, so tokens before them are emitted and forgotten.
Memory is bounded by the window and by the size of the memo of short pieces.
Text is cut at blanks; a stretch without a blank that exceeds ``LIMIT`` characters
is not held but taken in as it comes: normalised up to a place that later text
can't change, cut into pieces, the last of which stays open, and an open piece
that grows is merged as a stream.

Why the lookahead suffices: two runs of the merges that differ only right of
some place can differ at a token that starts at x only if a merge (t, w) at
some rank takes a token w that starts at x in one run and not in the other.
To carry the difference over t, a later merge must take as its right part t or
a token grown from t to the right. So differences travel along chains of
merges of rising rank, each passing the left part of one; the longest chain,
measured in the symbols of the left parts, bounds the way.

Decoding: vocabularies with a byte-level decoder turn token characters into
bytes, which an incremental UTF-8 state machine turns into text; those
without a decoder join their tokens by blanks, as the library does.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from milepost.llm.tokens import byte_alphabet
from milepost.llm.words import slices
from milepost.session import ship_package

#: Entries of a memo; a full one is emptied.
MEMO = 400_000
#: Symbols above which merges are found by a heap.
LINEAR = 64
#: Characters of text taken in at a time, and held in wait for a blank.
CHUNK = 1 << 16
LIMIT = 1 << 18


def lookahead(merges: list[tuple[str, str]], suffix: str = "") -> int:
    """Symbols left of the text's current end that later text may still change."""

    def size(token: str) -> int:
        return len(token.removesuffix(suffix)) if suffix else len(token)

    left = {a + b: a for a, b in reversed(merges)}
    best: dict[str, int] = defaultdict(int)  # longest chain that starts by taking a token grown from the key
    longest = 0
    for a, b in reversed(merges):  # from the last rank down: chains rise
        reach = size(a) + best[a]
        longest = max(longest, reach)
        token = b
        while token is not None:  # b and what it has grown from
            best[token] = max(best[token], reach)
            token = left.get(token)
    return longest


class Vocabulary:
    """What a tokenizer file says: ids, ranks, suffix, lookahead."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {m: r for r, m in enumerate(merges)}
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.words = bool(self.suffix)  # words without white space; else byte-level with blanks
        self.byte_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.token = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.letters = dict(enumerate(byte_alphabet()))
        self.bytes = {c: b for b, c in self.letters.items()}
        self.lookahead = lookahead(merges, self.suffix)

    def merged(self, symbols: list[str]) -> list[str]:
        """The merges of lowest rank first, leftmost first."""
        if len(symbols) > LINEAR:
            return self._merged_by_heap(symbols)
        rank, none = self.rank.get, len(self.rank)
        ranks = [rank(p, none) for p in zip(symbols, symbols[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((symbols[i - 1], symbols[i]), none)
            if i < len(ranks):
                ranks[i] = rank((symbols[i], symbols[i + 1]), none)
        return symbols


    def _merged_by_heap(self, symbols: list[str]) -> list[str]:
        """The same for many symbols: the next merge comes from a heap."""
        rank, n = self.rank.get, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, p) for i, p in enumerate(zip(symbols, symbols[1:])) if (r := rank(p)) is not None]
        heapify(heap)
        tokens: list[str | None] = list(symbols)
        while heap:
            _, i, (left, right) = heappop(heap)
            j = after[i]
            if j >= n or tokens[i] != left or tokens[j] != right:
                continue  # one of the two has been merged since
            tokens[i], tokens[j] = left + right, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n:
                    pair = (tokens[k], tokens[after[k]])
                    if (r := rank(pair)) is not None:
                        heappush(heap, (r, k, pair))
        return [t for t in tokens if t is not None]


_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_WORD_PIECES = regex.compile(rf"{_CONTRACTIONS}|\p{{L}}+|\p{{N}}|[^\s\p{{L}}\p{{N}}]+")
_BYTE_PIECES = regex.compile(rf"{_CONTRACTIONS}| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}]+|\s+(?!\S)|\s+")
#: White space of the splitting rules (Python's also has U+001C to U+001F).
_BLANKS = re.compile(r"[^\S\x1c-\x1f]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")
_BLANK = re.compile(r"[^\S\x1c-\x1f]")
#: How a piece goes on that ends in a letter, a digit, or another character.
_LETTERS, _DIGITS, _OTHERS = (regex.compile(p) for p in (r"\p{L}*", r"\p{N}*", r"[^\s\p{L}\p{N}]*"))
#: Characters that may combine with the one before them.
_JOINING = regex.compile(r"[\p{M}\u1161-\u1175\u11A8-\u11C2]")
#: Text that no later text can change.
_SETTLED = re.compile(r"(?s).*\S(?=[^\S\x1c-\x1f])")


class Encoder:
    """Text in, token ids out. ``feed`` takes any split of the text; ``finish`` ends it."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.window = max(64, 4 * vocabulary.lookahead)
        self.memo: dict[str, tuple[int, ...]] = {}
        self.special = sorted(vocabulary.special, key=len, reverse=True)
        self.special_re = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.pieces = _WORD_PIECES if vocabulary.words else _BYTE_PIECES
        self.held = ""

    # -- one piece -----------------------------------------------------------

    def piece_ids(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece (no boundary of the splitting rules inside it)."""
        out = self.memo.get(piece)
        if out is None:
            mapped = piece.encode("utf-8", "replace").decode("latin-1").translate(self.v.letters)
            if len(mapped) < self.window:
                symbols = list(mapped)
                symbols[-1] += self.v.suffix
                tokens: Iterable[str] = self.v.merged(symbols)
            else:
                stream = _Stable(self.v, self.window)
                tokens = [*stream.push(mapped), *stream.end()]
            ids = self.v.ids
            out = tuple([ids[t] for t in tokens if t in ids])
            if len(mapped) < self.window:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[piece] = out
        return out

    def unit_ids(self, unit: str) -> list[int]:
        """Ids of a stretch of text that ends where no piece can cross."""
        out: list[int] = []
        at = 0
        if self.special_re is None or not self.special_re.search(unit):
            return self._plain(unit)
        for m in self.special_re.finditer(unit):
            out += self._plain(unit[at : m.start()])
            out.append(self.v.special[m[0]])
            at = m.end()
        return out + self._plain(unit[at:] if at else unit)

    def _plain(self, text: str) -> list[int]:
        out: list[int] = []
        for p in self.pieces.findall(self._normal(text)):
            out += self.piece_ids(p)
        return out

    def _normal(self, text: str) -> str:
        if not self.v.words:
            return text
        # Lower case character by character: no rule looks at neighbours.
        return text.lower() if text.isascii() else "".join([c.lower() for c in unicodedata.normalize("NFC", text)])

    # -- the stream ----------------------------------------------------------

    def units(self, chunks: Iterable[str]) -> Iterator[str | Iterator[list[int]]]:
        """Stretches of the text that are encoded on their own. What follows the
        last blank after a word is held until more text, or the end, comes; a
        stretch that grows too long comes as lists of ids, to be read at once."""
        chunks = iter(chunks)
        for chunk in chunks:
            self.held += chunk
            if m := _SETTLED.match(self.held):
                yield from self._units(self.held[: m.end()])
                self.held = self.held[m.end() :]
            elif len(self.held) > LIMIT:
                yield self._stretch(chunks)
        held, self.held = self.held, ""
        if held:
            yield from self._units(held)

    def _units(self, text: str) -> Iterable[str]:
        if self.v.words:
            return [u for u in _BLANKS.split(text) if u] if _SEPARATORS.search(text) else text.split()
        return re.split(r"(?<=\S)(?= \S)", text)

    def _cut(self, text: str) -> int:
        """A place near the end that neither a character to come nor a special
        token spans; 0 if there is none."""
        longest = len(self.special[0]) if self.special else 0
        cut = len(text) - longest
        while cut > 0 and _JOINING.match(text, cut):
            cut -= 1
        if cut > 0 and self.special_re:
            for m in self.special_re.finditer(text, max(0, cut - longest)):
                if m.start() < cut < m.end():
                    return m.start()
        return max(cut, 0)

    def _stretch(self, chunks: Iterator[str]) -> Iterator[list[int]]:
        """Ids of the held text and of what follows it up to a blank."""
        raw, run = self.held, _Run(self)
        lead = len(raw) - len(raw.lstrip())
        while True:
            blank = _BLANK.search(raw, lead)
            stop = blank.start() if blank else self._cut(raw)
            text, raw, lead = raw[:stop], raw[stop:], 0
            chunk = None if blank else next(chunks, None)
            if not blank and chunk is None:  # the end
                text, raw = text + raw, ""
            at = 0
            for m in self.special_re.finditer(text) if self.special_re else ():
                yield run.push(self._normal(text[at : m.start()]), last=True) + [self.v.special[m[0]]]
                at = m.end()
            yield run.push(self._normal(text[at:]), last=chunk is None)
            if chunk is None:
                self.held = raw
                return
            raw += chunk

    def encode(self, chunks: Iterable[str]) -> Iterator[int]:
        for u in self.units(chunks):
            for ids in [self.unit_ids(u)] if isinstance(u, str) else u:
                yield from ids


class _Stable:
    """Merges of a piece that comes in parts: a token is given out once no later
    symbol can change it."""

    def __init__(self, vocabulary: Vocabulary, window: int):
        self.v, self.window = vocabulary, window
        self.buffer: list[str] = []

    def push(self, symbols: str) -> Iterator[str]:
        at = 0
        while at < len(symbols):
            room = self.window - len(self.buffer)
            self.buffer += symbols[at : at + room]
            at += room
            if len(self.buffer) < self.window:
                return
            end = 0
            for token in self.v.merged(list(self.buffer)):
                size = len(token)  # no suffix here: the piece goes on
                if end + size > len(self.buffer) - self.v.lookahead:
                    break
                yield token
                end += size
            del self.buffer[:end]
            if not end:  # a token longer than the window: wait for more
                self.window *= 2

    def end(self) -> list[str]:
        if not self.buffer:
            return []
        self.buffer[-1] += self.v.suffix
        return self.v.merged(self.buffer)


class _Run:
    """A stretch without a blank, taken in as it comes: whole pieces are given out,
    the last stays open; one that grows beyond the window is merged as a stream."""

    def __init__(self, encoder: Encoder):
        self.e = encoder
        self.open = ""
        self.stream: _Stable | None = None
        self.more = _LETTERS

    def _ids(self, tokens: Iterable[str]) -> list[int]:
        ids = self.e.v.ids
        return [ids[t] for t in tokens if t in ids]

    def _mapped(self, text: str) -> str:
        return text.encode("utf-8", "replace").decode("latin-1").translate(self.e.v.letters)

    def push(self, text: str, last: bool) -> list[int]:
        """Ids of what is settled now; ``last``: nothing follows the text."""
        out: list[int] = []
        if self.stream is not None:
            size = self.more.match(text).end()
            out += self._ids(self.stream.push(self._mapped(text[:size])))
            if size == len(text) and not last:
                return out
            out += self._ids(self.stream.end())
            self.stream, text = None, text[size:]
        text = self.open + text
        found = list(self.e.pieces.finditer(text))
        whole = len(found)
        if not last and found:
            # The last piece may go on; and an apostrophe with the first letter of
            # a contraction of two, as 'r of 're, may turn out to be one.
            whole -= 1
            if whole and found[whole][0] in ("r", "v", "l") and found[whole - 1][0] == "'":
                whole -= 1
        for m in found[:whole]:
            out += self.e.piece_ids(m[0])
        self.open = text[found[whole].start() :] if whole < len(found) else ""
        if len(self.open) > 4 * self.e.window and whole == len(found) - 1:
            end = self.open[-1]
            self.more = next((c for c in (_LETTERS, _DIGITS) if c.fullmatch(end)), _OTHERS)
            self.stream = _Stable(self.e.v, self.e.window)
            out += self._ids(self.stream.push(self._mapped(self.open)))
            self.open = ""
        return out


class Decoder:
    """Ids in, text out, as soon as whole characters are there."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        self.first = True

    def feed(self, token_id: int) -> str:
        token = self.v.token.get(token_id)
        if token is None:
            return ""
        if not self.v.byte_decoder:
            text, self.first = (token if self.first else " " + token), False
            return text
        try:
            return self.utf8.decode(bytes([self.v.bytes[c] for c in token]))
        except KeyError:  # a special token with characters that stand for no byte
            return self.utf8.decode(token.encode())

    def finish(self) -> str:
        return self.utf8.decode(b"", True)


class _Digests:
    """Per document: count, hash of the ids, hash of the decoded text."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.encoder = Encoder(self.v)
        self.memo: dict[str, tuple[int, bytes, bytes]] = {}

    def _rendered(self, ids: list[int]) -> tuple[int, bytes, bytes]:
        # Without a byte decoder the text of some ids doesn't depend on the others.
        text = b"" if self.v.byte_decoder else " ".join([self.v.token[i] for i in ids]).encode()
        return len(ids), " ".join(map(str, ids)).encode(), text

    def _learn(self, unit: str) -> tuple[int, bytes, bytes]:
        out = self._rendered(self.encoder.unit_ids(unit))
        if len(unit) < 256:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[unit] = out
        return out

    def of(self, text: str) -> tuple[int, str, str]:
        chunks = (text[i : i + CHUNK] for i in range(0, len(text), CHUNK))
        hash_ids, hash_text, n = hashlib.sha256(), hashlib.sha256(), 0
        decoder = Decoder(self.v)
        memo, learn, held = self.memo, self._learn, []

        def flush() -> None:
            nonlocal n
            some = [x for x in held if x[0]]
            held.clear()
            if not some:
                return
            sep = b" " if n else b""
            n += sum([x[0] for x in some])
            ids = b" ".join([x[1] for x in some])
            hash_ids.update(sep + ids)
            if self.v.byte_decoder:
                hash_text.update("".join([decoder.feed(int(i)) for i in ids.split()]).encode())
            else:
                hash_text.update(sep + b" ".join([x[2] for x in some]))

        for u in self.encoder.units(chunks):
            if isinstance(u, str):
                held.append(memo[u] if u in memo else learn(u))
                if len(held) >= 8192:
                    flush()
            else:
                for ids in u:
                    held.append(self._rendered(ids))
                    flush()
        flush()
        if self.v.byte_decoder:
            hash_text.update(decoder.finish().encode())
        return n, hash_ids.hexdigest(), hash_text.hexdigest()


@lru_cache(maxsize=4)
def _digests(path: str) -> _Digests:
    """Kept by the Python worker from task to task."""
    return _Digests(path)


def report(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A map over the rows: no shuffle, and a lost task is simply run again. Null
    text counts as empty (no tokens, both hashes of nothing); repeated rows
    give repeated results; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = _digests(path)
        for b in slices(batches, "text"):
            done = [digests.of(t) for t in b.column("text").to_pylist()]
            columns = [b.column("doc_id"), *(pa.array([d[k] for d in done], t) for k, t in enumerate(kinds))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    ship_package(docs.sparkSession)
    kinds = (pa.int64(), pa.string(), pa.string())
    narrow = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
