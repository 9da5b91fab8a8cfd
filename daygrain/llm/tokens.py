"""Token ids by the tokenizers library, remembered run by run.

A tokenizer that splits at white space gives each run of other characters the same ids wherever it stands. The runs of a batch
of texts are told apart by Arrow, the ids of those that are not known are asked for, many runs in one call, and the ids of a
text are those of its runs put together. What is known lies in three flat arrays (runs, ids, the batch that asked last), about
forty bytes a run. Only texts that hold a special token are encoded whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from daygrain.llm.common import held, strings

#: Runs whose ids a Python worker keeps; beyond it the half that was asked for last stays.
MOST_KEPT = 1_500_000
#: Bytes of text that are encoded at a time.
BATCH_BYTES = 8 << 20
#: New runs that the library is asked for in one call, and runs whose ids are put together at a time.
ASKED, JOINED = 1 << 13, 1 << 17
#: White space other than a single space or line feed between two other characters, as RE2 reads it; Python's class of it holds a little more.
ODD = "[\\t\\r\\x0b\\x0c\\x1c-\\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|  |\\n\\n| \\n|\\n |^[ \\n]|[ \\n]$"
#: Where a run ends in a text with such white space: before a space that stands alone.
BOUND = re.compile(r"(?<=[^\s\u180e])(?= [^\s\u180e])")
#: Runs whose number of words is known, where white space takes no part and where it does, and runs of letters with a sign, a word of its own.
JOINT = (r"^\pL+[.,;:!?]?$", "^ [^ ]+$")
SIGNED = "[.,;:!?]$"
ID = np.dtype("<u4")


def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _special(t) -> str:
    """What all special tokens begin with; a text that holds it is encoded whole. Empty if they have nothing in common: then all texts are."""
    return os.path.commonprefix([x.content for x in t.get_added_tokens_decoder().values()])


class Encoder:
    """encode_all(texts) gives each text's ids as little-endian unsigned 32-bit numbers.

    spaces_matter: white space takes part in the ids (byte-level vocabularies, whose tokens show a leading space); a run then
    keeps the single space before it, and an empty run stands for a line feed."""

    def __init__(self, path: str, spaces_matter: bool, most_kept: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are the parallelism
        self.t = tokenizer(path)
        self.spaces = spaces_matter
        self.most_kept = most_kept
        self.special = _special(self.t)
        self.runs, self.ids, self.asked, self.turn = pa.array([], pa.string()), pa.array([], pa.binary()), np.zeros(0, np.int32), 0
        # Which ids begin with a space, or end a word: the runs' bounds in a text of many runs.
        vocab = self.t.get_vocab()
        self.bound = np.zeros(max(vocab.values()) + 1, bool)
        self.bound[[i for w, i in vocab.items() if (w.startswith("\u0120") if spaces_matter else w.endswith("</w>"))]] = True

    def whole(self, text: str) -> bytes:
        return np.asarray(self.t.encode(text, add_special_tokens=False).ids, ID).tobytes()

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, ID) for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def _jointly(self, runs: pa.Array) -> pa.Array | None:
        """The ids of runs that are encoded as one text, in which their bounds show: a space, or the ends of the words that a run surely has, one
        of letters and one of a sign behind them. No run has fewer; if all have no more in sum, each has as many. Else None."""
        if self.spaces:
            text, words = pc.binary_join(pa.ListArray.from_arrays([0, len(runs)], runs), "")[0].as_py(), np.ones(len(runs), int)
        else:
            text = pc.binary_join(pa.ListArray.from_arrays([0, len(runs)], runs), " ")[0].as_py()
            words = 1 + pc.match_substring_regex(runs, SIGNED).to_numpy(zero_copy_only=False)
        ids = self._ids([text])[0]
        bounds = np.flatnonzero(self.bound[ids])
        if len(bounds) != words.sum():
            return None
        ends = np.append(bounds[1:], len(ids)) if self.spaces else bounds[np.cumsum(words) - 1] + 1
        offsets = (np.append(0, ends) * ID.itemsize).astype(np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(runs), [None, pa.py_buffer(offsets), pa.py_buffer(ids.tobytes())])

    def _ask(self, runs: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        """The ids of new runs, and their order: those that can be asked for jointly come first."""
        joint = pc.match_substring_regex(runs, JOINT[self.spaces])
        some, rest = runs.filter(joint), runs.filter(pc.invert(joint))
        found = self._jointly(some) if len(some) else some.cast(pa.binary())
        if found is None:
            rest, found = pa.concat_arrays([some, rest]), pa.array([], pa.binary())
        each = pa.array([x.tobytes() for x in self._ids([r or "\n" for r in rest.to_pylist()])], pa.binary())
        return np.argsort(~joint.to_numpy(zero_copy_only=False), kind="stable"), [found, each]

    def _known(self, runs: pa.Array) -> pa.Array:
        """The ids of distinct runs."""
        self.turn += 1
        at = pc.index_in(runs, value_set=self.runs)
        new = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        at = at.fill_null(0).to_numpy().astype(np.int64)
        ids, told = [self.ids], [self.runs]
        for i in range(0, len(new), ASKED):
            which = new[i : i + ASKED]
            some = runs.take(pa.array(which))
            order, found = self._ask(some)
            at[which[order]] = len(self.ids) + i + np.arange(len(which))
            ids += found
            told.append(some.take(pa.array(order)))
        self.ids, self.runs = pa.concat_arrays(ids), pa.concat_arrays(told)
        self.asked = np.append(self.asked, np.zeros(len(new), np.int32))
        self.asked[at] = self.turn
        out = self.ids.take(pa.array(at))
        if len(self.runs) > self.most_kept:
            stay = pa.array(np.sort(np.argsort(self.asked, kind="stable")[-max(1, self.most_kept // 2) :]))
            self.runs, self.ids, self.asked = self.runs.take(stay), self.ids.take(stay), self.asked[stay.to_numpy()]
        return out

    def _split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The runs of all texts, one after the other, and how many each has."""
        if not self.spaces:
            cut = pc.ascii_split_whitespace(texts)
            runs, n = cut.flatten(), pc.list_value_length(cut).to_numpy()
            empty = pc.equal(pc.binary_length(runs), 0)
            if pc.any(empty).as_py():
                of = np.repeat(np.arange(len(n)), n)[~empty.to_numpy(zero_copy_only=False)]
                runs, n = runs.filter(pc.invert(empty)), np.bincount(of, minlength=len(n))
            return runs, n
        odd = pc.match_substring_regex(texts, ODD)
        easy = texts.filter(pc.invert(odd))
        cut = pc.split_pattern(pc.replace_substring(pc.replace_substring(easy, "\n", "\n\n"), " ", "\n "), "\n")
        if not pc.any(odd).as_py():
            return cut.flatten(), pc.list_value_length(cut).to_numpy()
        parts = [BOUND.split(t) for t in texts.filter(odd).to_pylist()]
        both = pa.concat_arrays([cut, pa.array(parts, cut.type)])
        mask = odd.to_numpy(zero_copy_only=False)
        order = np.argsort(np.concatenate([np.flatnonzero(~mask), np.flatnonzero(mask)]))
        both = both.take(pa.array(order))
        return both.flatten(), pc.list_value_length(both).to_numpy()

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """texts: strings, or UTF-8 bytes, in which what isn't UTF-8 counts as U+FFFD. A null is an empty text."""
        texts = pc.fill_null(strings(texts), "")
        out = [b""] * len(texts)
        special = pc.match_substring(texts, self.special) if self.special else pa.array(np.ones(len(texts), bool))
        left = pc.and_(pc.invert(special), pc.greater(pc.binary_length(texts), 0)).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self.whole(texts[i].as_py())
        rows = np.flatnonzero(left)
        if not len(rows):
            return out
        runs, n = self._split(texts.take(pa.array(rows)))
        told = runs.dictionary_encode()
        ids, index, ends = self._known(told.dictionary), told.indices, np.cumsum(n)
        a = 0
        while a < len(rows):
            begin = int(ends[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(ends, begin + JOINED, side="right")))
            taken = ids.take(index.slice(begin, int(ends[b - 1]) - begin))
            _, offsets, data = taken.buffers()
            offsets = np.frombuffer(offsets, np.int32, len(taken) + 1)
            data = memoryview(data) if data is not None else memoryview(b"")
            cut = [0, *offsets[ends[a:b] - begin].tolist()]
            for i, x, y in zip(rows[a:b].tolist(), cut[:-1], cut[1:], strict=True):
                out[i] = bytes(data[x:y])
            a = b
        return out


def encoder(path: str, spaces_matter: bool, most_kept: int = MOST_KEPT) -> Encoder:
    return held(f"tokens {path} {spaces_matter} {most_kept}", lambda: Encoder(path, spaces_matter, most_kept))


def public(name: str) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
