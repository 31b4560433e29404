"""Token counts by a compiled finite-state transducer.

The vocabulary of a byte-fallback BPE model is compiled, as states are met, into a deterministic transducer over
characters. A state is what the encoding of any further text can depend on: the longest suffix that begins some longer
piece, the last piece of the encoding of each prefix behind which such a piece may begin, and the number of pieces of
those prefixes relative to the present one. A transition carries the change in the number of pieces, so summing what is emitted along
a text gives its token count.

Why this is enough: a sequence of pieces is the model's encoding exactly if each adjacent pair is (the pair, merged from
characters by the model's own rule, gives the pair back). So the encoding of a longer prefix is that of a shorter one
plus one piece that fits behind the shorter one's last piece.

Texts are joined and cut into equal chunks. A chunk's state map is constant from the first position at which the past
stops to matter (a space after a non-space, a character outside the vocabulary, a new text). All chunks advance in
lock step; maps compose by a prefix scan (the rightmost constant map before a chunk gives its entry state), and the
parts before the first such position then run from the states found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SPACE = "▁"
HOLD, TEXT, BYTES = 1, 2, 3  # classes: no change, start of a text, characters of 1 to 4 bytes outside the vocabulary
FIRST = 7
MIX = 0x9E3779B97F4A7C15


def merged(text: str, scores: dict[str, float]) -> list[str]:
    """The model's merge rule: best score first, leftmost among equals."""
    parts, lacking = list(text), float("-inf")
    pairs = [scores.get(a + b, lacking) for a, b in zip(parts, parts[1:], strict=False)]
    while pairs and (best := max(pairs)) > lacking:
        i = pairs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = scores.get(parts[i] + parts[i + 1], lacking)
        if i:
            pairs[i - 1] = scores.get(parts[i - 1] + parts[i], lacking)
    return parts


class Unfit(ValueError):
    """No piece fits behind a state: the vocabulary isn't one whose encodings are told by adjacent pairs."""


class Transducer:
    def __init__(self, scores: dict[str, float], max_states: int = 240_000, slot_bits: int = 22, plain: Callable[[str], int] | None = None):
        """scores: of all normal pieces. Beyond max_states or a third of the slots compilation starts anew from the states that
        are in use, also inside a text, so memory is bounded. plain: the model's own count, for texts that raise Unfit."""
        self.scores, self.max_states, self.shift, self.plain = scores, max_states, np.uint64(64 - slot_bits), plain
        self.slots = 1 << slot_bits
        self.begun = {p[:i] for p in scores for i in range(len(p))}
        self.classes = np.zeros(0x110000, np.int32)
        self.chars: list[str] = [""] * FIRST
        self.reset()

    def reset(self) -> None:
        self.fits: dict[tuple[str | None, str], bool] = {}
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.keys, self.packed, self.used = np.full(self.slots, -1, np.int64), np.zeros(self.slots, np.int64), 0
        self.root = self.state(("", (None,), (0,)))

    def full(self) -> bool:
        return len(self.states) > self.max_states or self.used > self.slots // 3

    def renewed(self, states: np.ndarray) -> np.ndarray:
        """The states after compilation has started anew: what they stand for is kept, their numbers and all transitions go."""
        values, back = np.unique(states, return_inverse=True)
        kept = [self.states[v] for v in values.tolist()]
        self.reset()
        return np.array([self.state(k) for k in kept], np.int64)[back]

    def state(self, key: tuple) -> int:
        n = self.number.get(key)
        if n is None:
            n = self.number[key] = len(self.states)
            self.states.append(key)
        return n

    def fit(self, left: str | None, right: str) -> bool:
        known = self.fits.get((left, right))
        if known is None:
            whole = [right] if left is None else [left, right]
            known = self.fits[left, right] = merged("".join(whole), self.scores) == whole
        return known

    def step(self, state: int, kind: int) -> int:
        """Compile one transition: next state and the change in the number of pieces, packed."""
        if kind == HOLD:
            to, more = self.states[state], 0
        elif kind == TEXT:
            to, more = self.after(self.states[self.root], SPACE)
        elif kind < FIRST:
            to, more = self.states[self.root], kind - BYTES + 1
        else:
            char, own = self.chars[kind], self.states[state]
            to, more = self.after(self.states[self.root] if char == SPACE and own[0][-1:] != SPACE else own, char)
        packed = self.state(to) << 8 | more + 128
        key = state << 21 | kind
        slot = (key * MIX & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
        while self.keys[slot] >= 0:
            slot = (slot + 1) % len(self.keys)
        self.keys[slot], self.packed[slot] = key, packed
        self.used += 1
        return packed

    def found(self, state: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """The packed transitions by linear probing, -1 where not compiled yet."""
        keys = state << 21 | kinds
        slots = ((keys.astype(np.uint64) * np.uint64(MIX)) >> self.shift).astype(np.int64)
        held = self.keys[slots]
        packed = self.packed[slots]
        odd = np.flatnonzero(held != keys)
        while len(odd):
            empty = held[odd] < 0
            packed[odd[empty]] = -1
            odd = odd[~empty]
            slots[odd] = (slots[odd] + 1) % len(self.keys)
            held[odd], packed[odd] = self.keys[slots[odd]], self.packed[slots[odd]]
            odd = odd[held[odd] != keys[odd]]
        return packed

    def after(self, own: tuple, char: str) -> tuple[tuple, int]:
        suffix, last, count = own
        text = suffix + char
        for i in range(len(text)):
            back = len(text) - i - 1
            if text[i:] in self.scores and last[back] != "" and self.fit(last[back], text[i:]):
                piece, more = text[i:], count[back] + 1
                break
        else:
            raise Unfit(f"no piece fits after {own}: {char!r}")
        while text not in self.begun:
            text = text[1:]
        use = [text[len(text) - j :] in self.begun for j in range(1, len(text) + 1)]  # may a piece begin that far back?
        return (text, (piece, *(p if u else "" for p, u in zip(last, use, strict=False))), (0, *(c - more if u else 0 for c, u in zip(count, use, strict=False)))), more

    def classify(self, codes: np.ndarray) -> np.ndarray:
        kinds = self.classes[codes]
        if len(new := np.unique(codes[kinds == 0])):
            for code in new.tolist():
                char = SPACE if code == 32 else chr(code)
                if char not in self.scores:
                    self.classes[code] = BYTES - 1 + len(char.encode())
                elif char == SPACE and self.classes[ord(SPACE)]:
                    self.classes[code] = self.classes[ord(SPACE)]
                else:
                    self.classes[code] = len(self.chars)
                    self.chars.append(char)
                    if char == SPACE:
                        self.classes[[32, ord(SPACE)]] = self.classes[code]
            kinds = self.classes[codes]
        return kinds

    def run(self, steps: np.ndarray, state: np.ndarray, out: np.ndarray, live: int | None = None) -> np.ndarray:
        """All columns of `steps` (time by lane) in lock step from `state`; `out` gets what is emitted. Only the first `live`
        lanes move; the states of the others are kept, whatever number they have afterwards."""
        live = len(state) if live is None else live
        for t in range(len(steps)):
            if self.full():
                state = self.renewed(state)
            kinds, now = steps[t], state[:live]
            packed = self.found(now, kinds)
            if packed.min() < 0:
                lacking = np.flatnonzero(packed < 0)
                pairs, back = np.unique(now[lacking] << 21 | kinds[lacking], return_inverse=True)
                packed[lacking] = np.array([self.step(int(p >> 21), int(p & 0x1FFFFF)) for p in pairs], np.int64)[back]
            state = np.concatenate([packed >> 8, state[live:]])
            out[t] = (packed & 255) - 128
        return state

    def follow(self, kinds: np.ndarray, key: tuple, out: np.ndarray) -> None:
        """One lane alone, from the state that `key` stands for."""
        known: dict[tuple[int, int], int] = {}
        state = self.state(key)
        for t, kind in enumerate(kinds.tolist()):
            packed = known.get((state, kind))
            if packed is None:
                if self.full():
                    state = int(self.renewed(np.array([state]))[0])
                    known = {}
                packed = int(self.found(np.array([state], np.int64), np.array([kind], np.int64))[0])
                packed = known[state, kind] = packed if packed >= 0 else self.step(state, kind)
            state = packed >> 8
            out[t] = (packed & 255) - 128

    def emitted(self, kinds: np.ndarray, lanes: int = 8192) -> np.ndarray:
        """What each position emits, the first being the start of a text."""
        n = len(kinds)
        lanes = max(1, min(lanes, n // 64))
        size = -(-n // lanes)
        padded = np.full(lanes * size, TEXT, np.int32)
        padded[:n] = kinds
        space = self.classes[32]
        free = (padded < FIRST) | ((padded == space) & (np.concatenate([[0], padded[:-1]]) != space) & (space > 0))
        free = free.reshape(lanes, size)
        constant = free.any(1)
        head = np.where(constant, free.argmax(1), size)
        steps = padded.reshape(lanes, size).T.astype(np.int64)
        steps[np.arange(size)[:, None] < head] = HOLD
        out = np.zeros((size, lanes), np.int8)
        ends = self.run(steps, np.full(lanes, self.root, np.int64), out)
        flat = out.T.reshape(-1).copy()
        # the prefix scan: before each chunk, the nearest chunk with a constant map
        before = np.concatenate([[-1], np.maximum.accumulate(np.where(constant, np.arange(lanes), -1))[:-1]])
        runs = [(int(b + 1) * size, k * size + int(head[k]), int(ends[b])) for k, b in enumerate(before) if b >= 0 and (constant[k] or k == lanes - 1) and (head[k] or b + 1 < k)]
        runs.sort(key=lambda r: r[0] - r[1])
        longest = runs[8][1] - runs[8][0] if len(runs) > 8 else 0  # the eight longest may outlast the others by far
        state, done = np.array([r[2] for r in runs], np.int64), 0
        if longest:
            begins, lengths = np.array([r[0] for r in runs]), np.array([r[1] - r[0] for r in runs])
            for t in range(longest):
                live = int(np.searchsorted(-lengths, -t, "left"))
                at = begins[:live] + t
                row = np.empty((1, live), np.int8)
                state = self.run(padded[at][None].astype(np.int64), state, row, live)
                flat[at] = row[0]
            done = longest
        left = runs[: 8 if longest else None]
        keys = [self.states[s] for s in state[: len(left)].tolist()]  # numbers change when compilation starts anew
        for key, (begin, end, _) in zip(keys, left, strict=True):
            if end - begin > done:
                self.follow(padded[begin + done : end], key, flat[begin + done : end])
        return flat[:n]

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; an empty text has none."""
        if not texts:
            return np.zeros(0, np.int64)
        try:
            return self.together(texts)
        except Unfit:
            if len(texts) > 1:
                return np.concatenate([self.counts([t]) for t in texts])
            if self.plain is None:
                raise
            return np.array([self.plain(texts[0]) if texts[0] else 0])

    def together(self, texts: list[str]) -> np.ndarray:
        codes = np.frombuffer(("\n" + "\n".join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[:-1]], dtype=np.int64)])
        kinds = self.classify(codes).copy()
        kinds[begins] = TEXT
        total = np.add.reduceat(self.emitted(kinds).astype(np.int64), begins)
        return np.where([bool(t) for t in texts], total, 0)


_compiled: dict[str, Transducer] = {}


def compiled(model_file: str) -> Transducer:
    """The transducer of a sentencepiece model with byte fallback, identity normalisation and a leading space."""
    if model_file not in _compiled:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(sp.vocab_size())
        kept = "  ﬁ Ａ\u3000e\u0301  x "  # a normaliser would change, join or cut something of it
        if sum(map(sp.is_byte, ids)) != 256 or sp.normalize(kept) != SPACE + kept.replace(" ", SPACE) or "".join(sp.encode("  a", out_type=str)) != SPACE * 3 + "a":
            raise ValueError(f"{model_file} isn't a model of the kind that can be compiled")
        _compiled[model_file] = Transducer({sp.id_to_piece(i): sp.get_score(i) for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}, plain=lambda t: len(sp.encode(t)))
    return _compiled[model_file]


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of `docs`: the columns `keep`, n_bytes, n_tokens and over_limit (n_tokens > limit).

    A null text counts as empty and has no tokens; repeated rows stay; extra columns are left out. Texts of any length
    are read whole; a task holds one slice of a batch and its transition table, both bounded.
    """
    source = docs.select(*keep, common.whole_text(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]) + ", n_bytes long, n_tokens long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(model_file)
        for batch in batches:
            for part in common.slices(batch, "__text", 4 << 20):
                sizes = pa.compute.binary_length(part["__text"]).cast("int64")
                tokens = pa.array(machine.counts(part["__text"].to_pylist()), "int64")
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], sizes, tokens], [*part.schema.names[:-1], "n_bytes", "n_tokens"])

    return source.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
