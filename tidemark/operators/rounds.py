"""The rounds of a resolution for a block of roots, over arrays in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# constraints held at once; roots that meet more are taken in parts, down to one root
HELD = 4_000_000
# rows of a batch that is handed back
ROWS = 65_536


def _starts(owner: np.ndarray, n: int) -> np.ndarray:
    """Where the rows of each of ``n`` owners begin, of rows sorted by owner; one more for the end."""
    return np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row each element of a column of lists stands in, and the elements."""
    return pc.list_parent_indices(lists).to_numpy().astype(np.int64), lists.flatten()


def _distinct(numbers: np.ndarray) -> np.ndarray:
    """Sorted, each once; np.unique hashes them first, which takes longer here."""
    numbers = np.sort(numbers)
    return numbers[np.concatenate([[True], numbers[1:] != numbers[:-1]])[: len(numbers)]]


def _ints(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(np.int64)


class Block:
    """What a block of roots can meet, numbered: datasets, releases, needs, and asks.

    An ask is a constraint on a dataset; it allows its releases from one rank to another. Asks are
    numbered by dataset, so asks of a root sorted by number lie together by dataset.
    """

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        rows = pa.Table.from_batches(batches).combine_chunks()
        datasets, versions, needs, asks, asked = (
            pa.concat_arrays(rows.column(n).chunks) for n in ("dataset", "versions", "needs", "asks", "asked")
        )
        self.datasets = datasets
        owner, self.versions = _flat(versions)
        self.first_release = _starts(owner, len(datasets))
        need_owner, needs = _flat(needs)
        need_rank, need_dataset, need_text = needs.flatten()
        ask_owner, asks = _flat(asks)
        ask_text, low, high = asks.flatten()
        start_owner, start_text = _flat(asked)
        coded = pa.concat_arrays([ask_text, need_text, start_text]).dictionary_encode()
        self.texts, codes = coded.dictionary, _ints(coded.indices)
        ask_code, need_code, start_code = np.split(codes, np.cumsum([len(ask_text), len(need_text)]))

        key = ask_owner * len(self.texts) + ask_code
        order = np.argsort(key)
        key, self.ask_dataset, self.ask_code = key[order], ask_owner[order], ask_code[order]
        self.low, self.high = _ints(low)[order], _ints(high)[order]
        release = self.first_release[need_owner] + _ints(need_rank) - 1
        need_ask = np.searchsorted(key, _ints(pc.index_in(need_dataset, value_set=datasets)) * len(self.texts) + need_code)
        order = np.argsort(release, kind="stable")
        self.need_ask, self.first_need = need_ask[order], _starts(release[order], len(self.versions))
        self.roots, self.start_root = np.unique(start_owner, return_inverse=True)
        self.start_ask = np.searchsorted(key, start_owner * len(self.texts) + start_code)

    def settled(self, first: int, end: int) -> Iterator[Settled]:
        """Roots ``first`` to ``end`` by rounds, in parts if they meet too much to hold."""
        found = self._rounds(first, end)
        if found is not None:
            yield found
            return
        middle = (first + end) // 2
        yield from self.settled(first, middle)
        yield from self.settled(middle, end)

    def _rounds(self, first: int, end: int) -> Settled | None:
        """All asks that these roots meet: the needs of a newly chosen release are asked in the next round."""
        n_asks, n_datasets = len(self.ask_dataset), len(self.datasets)
        here = (self.start_root >= first) & (self.start_root < end)
        new = _distinct((self.start_root[here] - first) * n_asks + self.start_ask[here])
        met, levels, level = new, np.zeros(len(new), np.int32), 0
        pairs, low, high = (np.zeros(0, np.int64) for _ in range(3))
        while len(new):
            root, ask = np.divmod(new, n_asks)
            pair = root * n_datasets + self.ask_dataset[ask]
            each = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            pair = pair[each]
            lowest, highest = np.maximum.reduceat(self.low[ask], each), np.minimum.reduceat(self.high[ask], each)
            place = np.searchsorted(pairs, pair)
            known = place < len(pairs)
            known[known] = pairs[place[known]] == pair[known]
            at, chosen = place[known], np.zeros(len(pair), np.int64)
            chosen[known] = np.where(low[at] <= high[at], high[at], 0)
            low[at] = lowest[known] = np.maximum(lowest[known], low[at])
            high[at] = highest[known] = np.minimum(highest[known], high[at])
            added = ~known
            pairs = np.insert(pairs, place[added], pair[added])
            low, high = np.insert(low, place[added], lowest[added]), np.insert(high, place[added], highest[added])

            rank = np.where(lowest <= highest, highest, 0)
            changed = (rank > 0) & (rank != chosen)
            root, dataset = np.divmod(pair[changed], n_datasets)
            release = self.first_release[dataset] + rank[changed] - 1
            count = self.first_need[release + 1] - self.first_need[release]
            needed = np.repeat(self.first_need[release] - np.cumsum(count) + count, count) + np.arange(count.sum())
            new = _distinct(np.repeat(root * n_asks, count) + self.need_ask[needed])
            place = np.searchsorted(met, new)
            before = place < len(met)
            before[before] = met[place[before]] == new[before]
            new, place, level = new[~before], place[~before], level + 1
            met, levels = np.insert(met, place, new), np.insert(levels, place, np.int32(level))
            if len(met) > HELD and end - first > 1:
                return None
        return Settled(self, first, met, levels, pairs, np.where(low <= high, high, 0))


class Settled:
    """Roots of a block with what they met: asks with their round, and datasets with the rank of their release or 0."""

    def __init__(self, block: Block, first: int, met: np.ndarray, levels: np.ndarray, pairs: np.ndarray, ranks: np.ndarray):
        self.block, self.levels, self.ranks = block, levels, ranks
        root, self.dataset = np.divmod(pairs, len(block.datasets))
        self.root = block.roots[first + root]
        at, self.ask = np.divmod(met, len(block.ask_dataset))
        # asks are sorted by root and dataset as the pairs are
        self.pair = np.searchsorted(pairs, at * len(block.datasets) + block.ask_dataset[self.ask])

    def problems(self) -> pa.Array:
        releases = np.diff(self.block.first_release)[self.dataset]
        return pa.array(["missing", "conflict"]).take(pa.array((releases > 0).astype(np.int8), mask=self.ranks > 0))

    def datasets(self) -> list[pa.Array]:
        """``root, dataset, version, constraints, problem``"""
        names, release = self.block.datasets, self.block.first_release[self.dataset] + self.ranks - 1
        version = self.block.versions.take(pa.array(release, mask=self.ranks == 0))
        count = pa.array(np.bincount(self.pair, minlength=len(self.ranks)))
        return [names.take(pa.array(self.root)), names.take(pa.array(self.dataset)), version, count, self.problems()]

    def constraints(self) -> list[pa.Array]:
        """``root, dataset, constraint, level``"""
        return [*self._asks(slice(None)), pa.array(self.levels)]

    def conflicts(self) -> list[pa.Array]:
        """``root, dataset, constraint, problem``, of datasets without a release."""
        bad = np.flatnonzero(self.ranks[self.pair] == 0)
        return [*self._asks(bad), self.problems().take(pa.array(self.pair[bad]))]

    def _asks(self, which) -> list[pa.Array]:
        names, pair = self.block.datasets, self.pair[which]
        text = self.block.texts.take(pa.array(self.block.ask_code[self.ask[which]]))
        return [names.take(pa.array(self.root[pair])), names.take(pa.array(self.dataset[pair])), text]


def rows_of(part: str, names: list[str]):
    """A function over the rows of a block that gives ``part`` of what its roots settle on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(batches)
        for settled in block.settled(0, len(block.roots)):
            found = pa.RecordBatch.from_arrays(getattr(settled, part)(), names)
            for at in range(0, len(found), ROWS):
                yield found.slice(at, ROWS)

    return run
