"""Fast exact encoding with the tokenizers library.

A text is cut at blanks where the vocabulary's own pre-tokenizer always cuts. The chunks of a batch
are dictionary-encoded by Arrow, each distinct one goes through the library once (many in one call,
parted by a special token), and its ids are kept in a bounded pool. Ids are those of encoding the
whole text; texts where a cut could matter take the library's whole-text path.
"""

from __future__ import annotations

import os

import numpy as np

#: Where a text must not be cut: a blank with white space on both sides belongs to one run; so must not texts that hold
#: our own mark or the start of a special string. (RE2 syntax.)
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\pZ]"
_WHOLE = {"byte": _SPACE + " " + _SPACE + r"|\x01|<\|", "word": r"<\|"}


#: A Latin letter before a sign: both pre-tokenizers end a match between them. (The apostrophe isn't among the signs.)
_CUT = r"([A-Za-zÀ-ÖØ-öø-ÿ])([.,!?;:#%&*$])"


def whole(texts: list[str], style: str) -> list[int]:
    """Numbers of the texts that must not be cut."""
    import pyarrow as pa
    import pyarrow.compute as pc

    return np.flatnonzero(pc.match_substring_regex(pa.array(texts, pa.large_string()), _WHOLE[style]).to_numpy(zero_copy_only=False)).tolist()


def chunked(texts: list[str], style: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct chunks, chunk number of each place, places per text) of texts that may be cut.

    Cuts are made at blanks and between a letter and a sign, where both pre-tokenizers end a match.
    "byte": a blank stays with the word behind it. "word": blanks and line ends are dropped and ASCII letters
    put in lower case, as the vocabulary's normalizer does.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    arr = pa.array(texts, pa.large_string())
    if style == "word":
        arr = pc.replace_substring_regex(pc.ascii_lower(pc.replace_substring(arr, "\n", " ")), _CUT, r"\1 \2")
    else:
        arr = pc.replace_substring_regex(arr, _CUT, "\\1 \x01\\2")
    parts = pc.split_pattern(arr, " ")
    coded = parts.flatten().dictionary_encode()
    names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    counts = np.diff(parts.offsets.to_numpy())
    if style == "word":
        if "" in names:
            kept = codes != names.index("")
            counts = np.add.reduceat(np.append(kept, False), np.cumsum(counts) - counts, dtype=np.int64) * (counts > 0) if len(counts) else counts
            codes = codes[kept]
        return names, codes, counts
    # the first chunk of a text has no blank in front
    firsts = np.cumsum(counts) - counts
    own = dict.fromkeys(codes[firsts].tolist())
    more = {c: len(names) + k for k, c in enumerate(own)}
    codes[firsts] = np.fromiter((more[c] for c in codes[firsts].tolist()), np.int64, len(firsts))
    return [x[1:] if x[:1] == "\x01" else " " + x for x in names] + [names[c] for c in own], codes, counts


class ChunkEncoder:
    """Ids of whole texts by a vocabulary file."""

    def __init__(self, path: str, style: str, capacity: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = self.tokenizer.get_added_tokens_decoder()
        self.mark, self.mark_id = next(((t.content, i) for i, t in special.items() if not t.normalized), (None, None))
        self.specials = [t.content for t in special.values() if not t.content.startswith("<|")]
        self.style, self.capacity = style, capacity
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.start, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> None:
        # texts with the start of a special string aren't cut, so only other special strings can be in a chunk
        odd = [c for c in chunks if any(s in c for s in self.specials)] if self.specials else []
        if self.mark is None or odd:
            apart = chunks if self.mark is None else odd
            ids = self._plain(apart)
            self._store(apart, np.fromiter((i for x in ids for i in x), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)))
            if self.mark is None:
                return
            left = set(odd)
            chunks = [c for c in chunks if c not in left]
        for at in range(0, len(chunks), 20_000):
            some = chunks[at : at + 20_000]
            ids = np.array(self._plain([self.mark.join(some) + self.mark])[0], np.uint32)
            ends = np.flatnonzero(ids == self.mark_id)
            if len(ends) != len(some):
                raise ValueError("a chunk's end was lost")
            self._store(some, ids[ids != self.mark_id], np.diff(ends, prepend=-1) - 1)

    def _store(self, chunks: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        base = len(self.start)
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(sizes) - sizes])
        self.length = np.concatenate([self.length, sizes])
        self.pool = np.concatenate([self.pool, ids])
        self.known.update(zip(chunks, range(base, base + len(chunks))))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids per text) of a batch; null is the empty text."""
        texts = [t or "" for t in texts]
        runs = {i: np.array(self._plain([texts[i]])[0], np.uint32) for i in whole(texts, self.style)}
        names, codes, counts = chunked(["" if i in runs else t for i, t in enumerate(texts)], self.style)
        known = self.known
        self._learn([c for c in names if c not in known])
        where = np.fromiter(map(known.__getitem__, names), np.int64, len(names))[codes]
        lengths = self.length[where]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.pool[np.repeat(self.start[where] - (ends - lengths), lengths) + np.arange(total)]
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        sizes = np.diff(edges)
        if runs:
            flat = np.concatenate([runs.get(i, flat[edges[i] : edges[i + 1]]) for i in range(len(texts))])
            sizes = np.array([len(runs[i]) if i in runs else sizes[i] for i in range(len(texts))], np.int64)
        if len(known) > self.capacity:
            self._thin(names)
        return flat, sizes

    def _thin(self, recent: list[str]) -> None:
        """Keep the chunks of the last batch only, and the oldest known ones (the frequent) up to half the capacity."""
        keep = dict.fromkeys(recent)
        for c in self.known:
            if len(keep) >= self.capacity // 2:
                break
            keep[c] = None
        at = np.fromiter(map(self.known.__getitem__, keep), np.int64, len(keep))
        start, length, pool = self.start[at], self.length[at], self.pool
        ends = np.cumsum(length)
        flat = pool[np.repeat(start - (ends - length), length) + np.arange(int(ends[-1]))]
        self._reset()
        self._store(list(keep), flat, length)


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, style: str, capacity: int = 600_000) -> ChunkEncoder:
    """One encoder for each Python worker; `capacity` bounds the chunks it remembers."""
    key = path, style, capacity
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(*key)
    return _ENCODERS[key]


def slices(batch, text_col: str, limit: int = 4 << 20):
    """Parts of an Arrow batch whose texts hold about `limit` bytes at most (or one row)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text_col))), 0).to_numpy(zero_copy_only=False)
    at, ends = 0, np.cumsum(size)
    while at < batch.num_rows:
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right"))
        stop = min(max(stop, at + 1), batch.num_rows)
        yield batch.slice(at, stop - at)
        at = stop
    pa.default_memory_pool().release_unused()
