"""Encoding with a public byte-level BPE tokenizer (problem 7): tree concatenation for long texts.

Short texts are encoded as they are. A long text is cut into pieces without regard to its words; the pieces are encoded
in parallel, in different tasks. At each join a window of both sides is encoded again and grown until it agrees with what
is outside it on either side, so that the result is the encoding of the whole text. The joins of a text are parallel too:
each sees only the edges of its two pieces, whose tokens stay where they are until they are strung together. Where edges
do not suffice, or the windows of two joins meet, the pieces of that text are joined two by two as a tree.

Why agreement suffices: (1) the splitting pattern looks at nothing before the place it starts from and at most three
characters beyond a part that ended earlier, so word parts that end well before the join stay, and from the first
part end that both the window and the right side have they go on alike; (2) inside one long unsplit word part, tokens are
those of the whole if each two neighbours are those of their joint text, which holds inside either side and inside
the window, and at the window's ends as soon as its outermost tokens are tokens of the sides.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.lineage import cut

PIECE_CHARS = 8192
EDGE_CHARS = 512


def default_ranks() -> str:
    """Path of byte_bpe_50k's ranks among the public tokenizers."""
    try:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.tiktoken")
    except ImportError:
        return "/opt/tokenizers/byte_bpe_50k.tiktoken"


#: The splitting pattern of the vocabulary, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PEEK = 3  # characters that the pattern may look at beyond the start of a part


@lru_cache(maxsize=4)
def encoder(ranks: str):
    """The tokenizer of a rank file; loaded once a worker."""
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


@lru_cache(maxsize=1)
def _splitter():
    import regex

    return regex.compile(PATTERN)


class Piece:
    """A stretch of text with its tokens."""

    def __init__(self, text: str, tokens: list[int]):
        self.text, self.tokens = text, tokens


def _tail(text: str, chars: int) -> int:
    """A place at least ``chars`` before the end where a word part of the whole text starts.

    A blank that follows a character other than a blank or apostrophe starts a part, whatever stands before it.
    """
    for m in reversed(list(re.finditer(r"(?<=[^\s'])\s", text[max(0, len(text) - chars - 400) : len(text) - chars]))):
        return max(0, len(text) - chars - 400) + m.start()
    return -1


def _bpe(enc, data: bytes) -> list[int]:
    return enc._encode_single_piece(data)


def _cover(sizes: list[int], want: int) -> tuple[int, int]:
    """How many of the leading sizes it takes to reach ``want``, and their sum."""
    n = total = 0
    while n < len(sizes) and total < want:
        total += sizes[n]
        n += 1
    return n, total


def join(left: Piece, right: Piece, enc, window: int = 16) -> Piece:
    """The encoding of left.text + right.text from those of its parts."""
    if not left.text or not right.text:
        return left if left.text else right
    text = left.text + right.text
    at = len(left.text)
    parts_of = _splitter().finditer
    # Where the whole text's parts are surely those of the left side: a part's start at least _PEEK before the join
    # and before its last part. Window starts are taken further back until one is found.
    back = max(window, _PEEK + 1)
    while True:
        low = _tail(left.text, back)
        if low < 0 and back < at:
            back *= 4
            continue
        low = max(low, 0)
        starts = [m.start() + low for m in parts_of(left.text[low:])]
        safe = [s for s in starts[:-1] if s + _PEEK <= at] or [low]
        break
    begin = safe[-1]
    # Right side: parts of the whole from begin on, until one ends where a part of the right side ends.
    ahead = max(window, 64)
    while True:
        right_ends = {m.end() + at for m in parts_of(right.text[:ahead])}
        whole = ahead >= len(right.text)
        if not whole:
            right_ends = {e for e in right_ends if e < at + ahead - _PEEK}
        spans, meet = [], None
        for m in parts_of(text[begin : at + ahead]):
            spans.append((m.start() + begin, m.end() + begin))
            if m.end() + begin in right_ends:
                meet = m.end() + begin
                break
        if meet is not None:
            break
        if whole:
            meet = len(text)
            break
        ahead *= 4
    # Tokens before begin stay, tokens after meet stay; the parts between are made anew.
    keep_left = _before(left.tokens, enc, len(left.text[begin:].encode()))
    keep_right, _ = _cover([len(enc.decode_single_token_bytes(t)) for t in right.tokens], len(text[at:meet].encode())) if meet > at else (0, 0)
    made: list[int] = []
    for s, e in spans:
        part = text[s:e]
        if s < at < e and min(at - s, e - at) > 4 * window:
            made += _long_part(part, at - s, left.tokens, right.tokens, enc, window)
        else:
            made += _bpe(enc, part.encode())
    return Piece(text, left.tokens[:keep_left] + made + right.tokens[keep_right:])


def _before(tokens: list[int], enc, size: int) -> int:
    """Index of the token that starts ``size`` bytes before the end."""
    n = len(tokens)
    while size > 0:
        n -= 1
        size -= len(enc.decode_single_token_bytes(tokens[n]))
    return n


def _long_part(part: str, at: int, left: list[int], right: list[int], enc, window: int) -> list[int]:
    """Tokens of one unsplit part that crosses the join, from the sides' tokens where their edges agree."""
    size_l, size_r = len(part[:at].encode()), len(part[at:].encode())
    bytes_of = enc.decode_single_token_bytes
    a = left[_before(left, enc, size_l) :]
    if sum(len(bytes_of(t)) for t in a) != size_l:
        return _bpe(enc, part.encode())
    n, total = _cover([len(bytes_of(t)) for t in right], size_r)
    if total != size_r:
        return _bpe(enc, part.encode())
    b = right[:n]
    k = window
    while True:
        head, tail = a[-k:], b[:k]
        new = _bpe(enc, b"".join(map(bytes_of, head + tail)))
        left_agrees = k >= len(a) or new[0] == head[0]
        right_agrees = k >= len(b) or new[-1] == tail[-1]
        # The sides' own part ends near the join lie inside the window (they are within _PEEK characters of it).
        if left_agrees and right_agrees and len(new) > 1:
            return a[: max(0, len(a) - k)] + new + b[k:]
        if k >= len(a) and k >= len(b):
            return new
        k *= 2


class Edge(Piece):
    """The end or start of a piece, at a token's border; ``whole``: it is all of the piece."""

    def __init__(self, text: str, tokens: list[int], whole: bool):
        super().__init__(text, tokens)
        self.whole = whole


def edge(text: str, tokens: list[int], chars: int, enc, at_end: bool) -> Edge:
    """At least ``chars`` characters of one side of a piece with their tokens."""
    bytes_of = enc.decode_single_token_bytes
    held: list[int] = []
    data = b""
    for token in reversed(tokens) if at_end else tokens:
        held.append(token)
        data = bytes_of(token) + data if at_end else data + bytes_of(token)
        if len(data) >= chars:
            try:
                if len(found := data.decode()) >= chars:
                    return Edge(found, held[::-1] if at_end else held, len(held) == len(tokens))
            except UnicodeDecodeError:  # inside a character
                continue
    return Edge(text, tokens, True)


def _one_kind(text: str) -> bool:
    """Whether a text is inside one run that the pattern does not split: letters, numbers, blanks, or other signs."""
    return bool(_runs().fullmatch(text))


@lru_cache(maxsize=1)
def _runs():
    import regex

    return regex.compile(r"\p{L}{8,}|\p{N}{8,}|\s{8,}|[^\s\p{L}\p{N}]{8,}")


def _counted(tokens: list[int], size: int, enc) -> int | None:
    """How many of the leading tokens make up exactly ``size`` bytes."""
    n, total = _cover([len(enc.decode_single_token_bytes(t)) for t in tokens], size)
    return n if total == size else None


def _meeting(a: list[int], b: list[int], enc, window: int, a_ends: bool, b_ends: bool, lost: int = 0) -> tuple[int, list[int], int] | None:
    """(tokens given up of a, tokens in their place, tokens given up of b) for one unsplit part that crosses a join.

    ``a_ends``, ``b_ends``: the part begins where a does, ends where b does; otherwise the window must agree inside.
    ``lost``: bytes at the end of a that belong to the next part.
    """
    bytes_of = enc.decode_single_token_bytes
    k = window
    while True:
        head, tail = a[-k:], b[:k]
        data = b"".join(map(bytes_of, head + tail))
        new = _bpe(enc, data[: len(data) - lost] if lost else data)
        left = (k >= len(a) and a_ends) or (k < len(a) and new[:1] == head[:1])
        right = bool(lost) or (k >= len(b) and b_ends) or (k < len(b) and new[-1:] == tail[-1:])
        if left and right and len(new) > 1:
            return len(head), new, len(tail)
        if k >= len(a) and k >= len(b):
            return (len(head), new, len(tail)) if a_ends and (b_ends or lost) else None
        k *= 2


def joint(left: Edge, right: Edge, enc, first: bool, window: int = 16) -> tuple[int, list[int], int] | None:
    """(tokens given up of the left piece, tokens in their place, tokens given up of the right piece); None if the edges do not suffice.

    ``first``: the left piece is the start of the text.
    """
    at, text = len(left.text), left.text + right.text
    size = lambda s: len(s.encode())
    parts_of = _splitter().finditer
    low, back = -1, max(window, _PEEK + 1)
    while low < 0 and back < at:
        low = _tail(left.text, back)
        back *= 4
    if low < 0 and first and left.whole:
        low = 0
    inside = low < 0  # all of the left edge is inside one part
    if inside and not _one_kind(left.text):
        return None
    begin = 0
    if not inside:
        starts = [m.start() + low for m in parts_of(left.text[low:])]
        begin = ([s for s in starts[:-1] if s + _PEEK <= at] or [low])[-1]
    sure = len(text) if right.whole else len(text) - _PEEK - 1
    ends = {m.end() + at for m in parts_of(right.text) if m.end() + at <= sure}
    spans = []
    for m in parts_of(text[begin:]):
        spans.append((m.start() + begin, m.end() + begin))
        if spans[-1][1] in ends or spans[-1][1] == at:
            break
    meet = spans[-1][1]
    open_ = meet not in ends and meet != at
    if open_ and (right.whole or spans[-1][0] >= at or not _one_kind(right.text)):
        return None  # an open part must cross the join and fill the right edge
    if meet == at and inside and len(spans) == 1:
        return 0, [], 0
    if meet == at and not inside:  # the right side starts a part of its own
        given = _counted(left.tokens[::-1], size(left.text[begin:]), enc)
        return None if given is None else (given, [t for s, e in spans for t in _bpe(enc, text[s:e].encode())], 0)
    dropped = 0 if open_ or meet == at else _counted(right.tokens, size(text[at:meet]), enc)
    given = 0 if inside else _counted(left.tokens[::-1], size(left.text[begin:]), enc)
    if dropped is None or given is None:
        return None
    made: list[int] = []
    for n, (s, e) in enumerate(spans):
        if inside and n == 0 and e < at:  # a run of blanks whose last one goes with the next word
            found = _meeting(left.tokens, [], enc, window, False, True, size(text[e:at]))
            if found is None:
                return None
            given, made = found[0], made + found[1]
        elif s < at < e and (inside or open_ or min(at - s, e - at) > 4 * window):
            own = left.tokens if inside and n == 0 else left.tokens[len(left.tokens) - (_counted(left.tokens[::-1], size(text[s:at]), enc) or len(left.tokens)) :]
            aligned = e == meet and not open_
            others = right.tokens if open_ else right.tokens[:dropped] if aligned else _bpe(enc, text[at:e].encode())
            found = _meeting(own, others, enc, window, not (inside and n == 0), not open_)
            if found is None or (own is not left.tokens and size(text[s:at]) != sum(len(enc.decode_single_token_bytes(t)) for t in own)):
                return None
            if inside and n == 0:
                given = found[0]
                made += found[1]
            else:
                made += own[: len(own) - found[0]] + found[1]
            if open_ or aligned:
                dropped = found[2]
            else:
                made += others[found[2] :]
        else:
            made += _bpe(enc, text[s:e].encode())
    return given, made, dropped


def join_all(pieces: list[Piece], enc) -> Piece:
    """Two by two, as a tree."""
    while len(pieces) > 1:
        pieces = [join(*pieces[i : i + 2], enc) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
    return pieces[0]


def _ids(lists: list) -> pa.Array:
    ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
    flat = np.concatenate(lists).astype(np.int32) if lists else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))


def encode_column(df: DataFrame, columns: list[str], text: str, ranks: str) -> DataFrame:
    """``columns`` of ``df`` and ``ids``: each text encoded on its own; null as the empty list."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks)
        for batch in batches:
            texts = batch.column(len(columns)).to_pylist()
            ids = _ids([enc.encode_to_numpy(t) if t else np.empty(0, np.int32) for t in texts])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], ids], [*columns, "ids"])

    return df.select(*columns, text).mapInArrow(run, f"{kinds}, ids array<int>")


def encode(df: DataFrame, key: str, text: str = "text", *, ranks: str | None = None, piece_chars: int = PIECE_CHARS, edge_chars: int = EDGE_CHARS) -> DataFrame:
    """(key, ids): the ids of every text, without special tokens; their strings in a text are ordinary text.

    A null text and an empty text have no ids (an empty list). Every row gives one row, repeated and null keys too.
    Equal long texts are encoded once. Text is taken as stored. Other columns of ``df`` are ignored.
    """
    ranks = ranks or default_ranks()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    short = rows.where(F.coalesce(F.length("text"), F.lit(0)) <= piece_chars)
    long = rows.where(F.length("text") > piece_chars).withColumn("name", F.sha2("text", 256))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for at in range(0, len(whole), 64 * piece_chars):
                    pieces = [whole[i : i + piece_chars] for i in range(at, min(at + 64 * piece_chars, len(whole)), piece_chars)]
                    places = pa.array(range(at // piece_chars, at // piece_chars + len(pieces)), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(pieces)), places, pa.array(pieces)], ["name", "no", "piece"])

    def encode_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            ids = [enc.encode_ordinary(t) for t in texts]
            out = [*batch.columns, _ids(ids)]
            for at_end in (False, True):
                edges = [edge(t, own, edge_chars, enc, at_end) for t, own in zip(texts, ids)]
                out += [pa.array([e.text for e in edges]), _ids([e.tokens for e in edges]), pa.array([e.whole for e in edges], pa.bool_())]
            yield pa.RecordBatch.from_arrays(out, ["name", "no", "piece", "ids", *(f"{side}_{c}" for side in ("start", "end") for c in ("text", "ids", "whole"))])

    def join_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks)
        for batch in batches:
            sides = [batch.column(c).to_pylist() for c in ("no", "end_text", "end_ids", "end_whole", "start_text", "start_ids", "start_whole")]
            found = [joint(Edge(*left), Edge(*right), enc, no == 0) for no, *both in zip(*sides) for left, right in [(both[:3], both[3:])]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("name"), batch.column("no"), pa.array([f is not None for f in found], pa.bool_()), pa.array([f[0] if f else 0 for f in found], pa.int32()),
                    _ids([f[1] if f else [] for f in found]), pa.array([f[2] if f else 0 for f in found], pa.int32()),
                ],
                ["name", "no", "good", "given", "made", "dropped"],
            )

    def merge(name: tuple, table: pa.Table) -> pa.Table:
        enc = encoder(ranks)
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("no", "piece", "ids"))))
        whole = join_all([Piece(t, ids) for _, t, ids in rows], enc)
        return pa.table({"name": pa.array([name[0].as_py()], pa.string()), "ids": pa.array([whole.tokens], pa.list_(pa.int32()))})

    edges = ", ".join(f"{side}_text string, {side}_ids array<int>, {side}_whole boolean" for side in ("start", "end"))
    pieces = long.dropDuplicates(["name"]).select("name", "text").mapInArrow(cut_up, "name string, no int, piece string").repartition("name", "no")
    pieces = cut(pieces.mapInArrow(encode_pieces, f"name string, no int, piece string, ids array<int>, {edges}"))
    starts = pieces.select("name", (F.col("no") - 1).alias("no"), "start_text", "start_ids", "start_whole")
    joints = pieces.select("name", "no", "end_text", "end_ids", "end_whole").join(starts, ["name", "no"])
    joints = cut(joints.mapInArrow(join_edges, "name string, no int, good boolean, given int, made array<int>, dropped int"))
    before = joints.select("name", (F.col("no") + 1).alias("no"), F.col("good").alias("good_before"), F.col("dropped"))
    own = pieces.select("name", "no", "ids").join(joints.drop("dropped"), ["name", "no"], "left").join(before, ["name", "no"], "left")
    kept = F.size("ids") - F.coalesce("given", F.lit(0)) - F.coalesce("dropped", F.lit(0))
    part = F.concat(F.slice("ids", F.coalesce("dropped", F.lit(0)) + 1, F.greatest(kept, F.lit(0))), F.coalesce("made", F.array().cast("array<int>")))
    good = F.coalesce("good", F.lit(True)) & F.coalesce("good_before", F.lit(True)) & (kept >= 0)
    strung = own.select("name", good.alias("good"), F.struct("no", part.alias("part")).alias("p")).groupBy("name").agg(
        F.bool_and("good").alias("good"), F.array_sort(F.collect_list("p")).alias("p")
    )
    joined = strung.where("good").select("name", F.flatten(F.col("p.part")).alias("ids"))
    rest = pieces.join(strung.where("not good").select("name"), "name", "left_semi").groupBy("name").applyInArrow(merge, "name string, ids array<int>")
    whole = joined.union(rest)
    return encode_column(short, ["key"], "text", ranks).union(long.select("key", "name").join(whole, "name").select("key", "ids")).select(F.col("key").alias(key), "ids")
