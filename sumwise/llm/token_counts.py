"""Token counts of whole texts by finite-state transducers compiled from a vocabulary file.

Two deterministic transducers stand for a byte-level BPE tokenizer:

* The **splitter** reads classes of characters and says where a piece of the text begins.
  It has twelve states.  A chunk of text is then a map from the state before it to the state
  after it; the chunks of a batch are mapped side by side, their maps are composed by a
  parallel prefix scan, and a second pass over all chunks emits the boundaries.
* The **counter** reads the bytes of one piece.  Every transition is annotated with the
  number of tokens by which the encoding of the prefix grows (it may shrink).  A state is
  what later bytes depend on: for every place from which a token may still be under way,
  its node in the trie of tokens, the last token before it and the tokens since.  States are
  compiled when a text first needs them.

The counts equal those of the `tokenizers` library: without begin, end or added tokens,
without padding or truncation, and with special strings inside a text read as the one token
they name, which is the library's default.

Edge cases: a null text counts as empty, an empty text has no tokens, a null id is kept,
repeated rows are counted each, an empty table gives an empty result, further columns of the
input are ignored.  Texts of any length are read whole; memory grows with the longest text.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumwise.llm.common import per_worker, slices

#: Characters that are mapped side by side, and the length of one chunk of them.
BATCH_BYTES = 4 << 20
CHUNK = 2048
#: Compiled states and counted pieces that a worker keeps; both are caches and start afresh when full.
MOST_STATES = 300_000
MOST_PIECES = 500_000

LETTER, NUMBER, BLANK, WHITE, QUOTE, OTHER, ONE, RV, EL, E, RESET = range(11)
START, WORD, DIGITS, SIGNS, BLANK1, WHITE1, BLANKS, WHITES, QUOTED, QUOTED_RV, QUOTED_L, CLITIC = range(12)
LETTERS = (LETTER, ONE, RV, EL, E)
HERE, BEFORE = 1, 2  # a piece begins at this character, at the one before it


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output of the pieces a byte-level tokenizer takes.

    Pieces are clitics ('s 't 'm 'd 're 've 'll), runs of letters, of numbers or of other
    signs, each with one blank before it, and runs of white space up to the last of it.
    """
    after = np.zeros((12, 11), np.uint8)
    out = np.zeros((12, 11), np.uint8)
    fresh = {QUOTE: QUOTED, NUMBER: DIGITS, OTHER: SIGNS, BLANK: BLANK1, WHITE: WHITE1} | dict.fromkeys(LETTERS, WORD)
    attached = {**fresh, QUOTE: SIGNS}
    for state in range(12):
        for kind in range(10):
            to, says = fresh[kind], HERE
            white = kind in (BLANK, WHITE)
            if state in (BLANK1, WHITE1, BLANKS, WHITES):
                many = BEFORE if state in (BLANKS, WHITES) else 0
                if white:
                    to, says = (BLANKS if kind == BLANK else WHITES), 0
                elif state in (BLANK1, BLANKS):
                    to, says = attached[kind], many
                else:
                    says = HERE | many
            elif (state, to) in ((WORD, WORD), (DIGITS, DIGITS)):
                says = 0
            elif state in (SIGNS, QUOTED) and kind in (QUOTE, OTHER):
                to, says = SIGNS, 0
            elif state == QUOTED and kind in (ONE, RV, EL):
                to, says = {ONE: CLITIC, RV: QUOTED_RV, EL: QUOTED_L}[kind], 0
            elif (state, kind) in ((QUOTED_RV, E), (QUOTED_L, EL)):
                to, says = CLITIC, 0
            elif state in (QUOTED_RV, QUOTED_L):
                says = BEFORE if kind in LETTERS else BEFORE | HERE
            after[state, kind], out[state, kind] = to, says
        after[state, RESET] = START
        out[state, RESET] = HERE | (BEFORE if state in (QUOTED_RV, QUOTED_L) else 0)
    return after.ravel(), out.ravel()


def kinds_of_characters() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        group = unicodedata.category(chr(code))[0]
        if group == "L":
            kinds[code] = LETTER
        elif group == "N":
            kinds[code] = NUMBER
        elif group == "Z":
            kinds[code] = WHITE
    kinds[[9, 10, 11, 12, 13, 0x85]] = WHITE
    kinds[ord(" ")], kinds[ord("'")] = BLANK, QUOTE
    for letters, kind in (("stmd", ONE), ("rv", RV), ("l", EL), ("e", E)):
        kinds[[ord(c) for c in letters]] = kind
    return kinds


def piece_starts(kinds: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """True where a piece begins; `kinds` are classes of characters, RESET between texts."""
    after, out = per_worker("splitter", splitter)
    n = len(kinds)
    lanes = max(1, -(-n // chunk))
    padded = np.full(lanes * chunk, RESET, np.uint8)
    padded[:n] = kinds
    columns = np.ascontiguousarray(padded.reshape(lanes, chunk).T)
    # Maps of the chunks: all states until they agree, which a few characters bring about.
    states = np.repeat(np.arange(12, dtype=np.uint8)[:, None], lanes, axis=1)
    split = min(32, chunk)
    for kind in columns[:split]:
        states = after[states * np.uint8(11) + kind]
    agreed = (states == states[0]).all(axis=0)
    one, rest = states[0, agreed], states[:, ~agreed]
    for kind in columns[split:, agreed]:
        one = after[one * np.uint8(11) + kind]
    for kind in columns[split:, ~agreed]:
        rest = after[rest * np.uint8(11) + kind]
    states[:, agreed], states[:, ~agreed] = one, rest
    # Prefix scan: after each step a map covers twice as many chunks.
    maps, step = np.ascontiguousarray(states.T), 1
    while step < lanes:
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), axis=1)
        step *= 2
    state = np.concatenate([[START], maps[:-1, START]]).astype(np.uint8)
    says = np.empty_like(columns)
    for i, kind in enumerate(columns):
        at = state * np.uint8(11) + kind
        says[i], state = out[at], after[at]
    flat = np.ascontiguousarray(says.T).ravel()[: n + 1]
    begins = (flat & HERE).astype(bool)
    begins[:-1] |= (flat[1:] & BEFORE).astype(bool)
    return begins[:n]


class Counter:
    """The number of tokens of a piece, by a transducer over its bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        split, model = file["pre_tokenizer"], file["model"]
        plain = not file.get("normalizer") and not model.get("ignore_merges") and not model.get("unk_token")
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or not plain:
            raise ValueError("only byte-level BPE without prefix space or normalizer can be compiled")
        self.special = [t["content"] for t in file["added_tokens"] if t["special"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in file["added_tokens"]):
            raise ValueError("special tokens that take in their surroundings cannot be compiled")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ids = {c: b for c, b in byte_of.items()}
        self.parts: list[tuple[int, int] | None] = [None] * 256
        self.merge: dict[int, int] = {}
        spelled = [bytes([b]) for b in range(256)]
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            made = len(spelled)  # ids here are ranks: bytes first, then merges in their order
            a, b = ids[left], ids[right]
            ids[left + right] = made
            self.merge[a << 17 | b] = made
            self.parts.append((a, b))
            spelled.append(spelled[a] + spelled[b])
        if len(spelled) > 1 << 17 or max(map(len, spelled)) > 255:
            raise ValueError("the numbers of a state hold 131,072 tokens of up to 255 bytes")
        self.trie: dict[int, int] = {}
        self.token = [-1]
        for number, word in enumerate(spelled):
            node = 0
            for byte in word:
                node = self.trie.setdefault(node << 8 | byte, len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
            self.token[node] = number
        self.under_way = {edge >> 8 for edge in self.trie}  # nodes from which a longer token can follow
        self.allowed: dict[int, bool] = {}
        self.sides: tuple[dict[int, list], dict[int, list]] = ({}, {})
        self.pieces: dict[str, int] = {}
        self.restart()

    def restart(self) -> None:
        # An item of a state is one number: node of the trie, token before it + 1, tokens since + 256.
        # A step is one number too: next state, growth + 128.
        self.states = [(256,)]
        self.number = {self.states[0]: 0}
        self.steps: dict[int, int] = {}
        self.allowed.clear()

    def stands(self, a: int, b: int) -> bool:
        """Whether the tokens stay apart, that is no merge across their border comes first.

        While `a` and `b` are put together, their inner ends grow token by token.  A merge of
        two ends wins if it ranks before the merge that takes up either of them; of equal
        merges the left one goes first.
        """
        known = self.allowed.get(a << 17 | b)
        if known is None:
            merge, starts = self.merge, self.side(b, 0)
            known = True
            for x, taken_x in self.side(a, 1):
                x <<= 17
                for y, taken_y in starts:
                    made = merge.get(x | y)
                    if made is not None and made < taken_x and made <= taken_y:
                        known = False
            self.allowed[a << 17 | b] = known
        return known

    def side(self, token: int, right: int) -> list[tuple[int, int]]:
        """The tokens that end (or start) `token` while it is put together, each with the merge that takes it up."""
        known = self.sides[right].get(token)
        if known is None:
            known = self.sides[right][token] = [(token, 1 << 60)]
            while (of := self.parts[known[-1][0]]) is not None:
                known.append((of[right], known[-1][0]))
        return known

    def compile(self, at: int) -> int:
        """The step for a byte in a state, `at` being state << 8 | byte."""
        trie, tokens, under_way, allowed = self.trie, self.token, self.under_way, self.allowed
        byte, last, grown, moved = at & 255, -1, 0, []
        for item in self.states[at >> 8]:
            to = trie.get(item >> 27 << 8 | byte)
            if to is None:
                continue
            if to in under_way:
                moved.append(to << 27 | item & 0x7FFFFFF)
            if last < 0 <= (token := tokens[to]):
                before = (item >> 9 & 0x3FFFF) - 1
                fits = before < 0 or allowed.get(before << 17 | token)
                if fits is None:
                    fits = self.stands(before, token)
                if fits:
                    last, grown = token, (item & 511) - 255
        made = (*[item - grown for item in moved], last + 1 << 9 | 256)
        number = self.number.setdefault(made, len(self.states))
        if number == len(self.states):
            self.states.append(made)
        self.steps[at] = step = number << 8 | grown + 128
        return step

    def tokens(self, piece: bytes) -> int:
        if len(self.states) > MOST_STATES:
            self.restart()
        known, step, count = self.steps.get, 0, -128 * len(piece)
        for byte in piece:
            at = step & -256 | byte
            step = known(at) or self.compile(at)
            count += step & 255
        return count


def counts(texts: list[str | None], counter: Counter) -> np.ndarray:
    """Tokens of each text."""
    kinds_of = per_worker("kinds", kinds_of_characters)
    pieces_known = counter.pieces
    total = np.zeros(len(texts), np.int64)
    if not texts:
        return total
    parts: list[str] = []
    owner: list[int] = []
    for i, text in enumerate(texts):
        split = [text or ""]
        for name in counter.special:
            split = [s for part in split for s in part.split(name)]
        total[i] += len(split) - 1
        parts += split
        owner += [i] * len(split)
    whole = "\n".join(parts) + "\n"
    kinds = kinds_of[np.frombuffer(whole.encode("utf-32-le"), np.uint32)]
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    kinds[ends] = RESET
    starts = np.flatnonzero(piece_starts(kinds) | (np.concatenate([[RESET], kinds[:-1]]) == RESET))
    separator = kinds[starts] == RESET
    at = starts.tolist()
    pieces = [whole[i:j] for i, j in zip(at, [*at[1:], len(whole)])]
    found = list(map(pieces_known.get, pieces))
    for k, n in enumerate(found):
        if n is None:
            piece = pieces[k]
            found[k] = n = counter.tokens(piece.encode())
            if len(piece) <= 64:
                if len(pieces_known) >= MOST_PIECES:
                    pieces_known.clear()
                pieces_known[piece] = n
    tokens = np.array(found, np.int64) * ~separator
    of = np.asarray(owner)[np.cumsum(separator) - separator]
    return total + np.bincount(of, tokens, len(texts)).astype(np.int64)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`id`, n_bytes, n_tokens and over_limit (more than `limit` tokens) of every row.

    `vocabulary` is the path of a byte-level BPE file of the `tokenizers` library, which
    every worker reads.
    """
    kind = docs.schema[id].dataType.simpleString()
    arrow_types = pa.schema([("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = per_worker(f"counter {vocabulary}", lambda: Counter(vocabulary))
        for batch in slices(batches, "text", BATCH_BYTES):
            n = counts(batch.column("text").to_pylist(), counter)
            n_bytes = pa.compute.binary_length(batch.column("text")).fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), n_bytes, pa.array(n), pa.array(n > limit)],
                schema=pa.schema([batch.schema.field("id"), *arrow_types]),
            )

    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    found = rows.mapInArrow(counted, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return found.withColumnRenamed("id", id)
