"""Mentions by a large dictionary: one automaton over all aliases, walked once through every text.

The aliases' characters become a trie whose missing steps follow the longest suffix that is a node (Aho and Corasick), filled in
as a table of node by character, so a step is one look-up whatever the dictionary's size. The table is built once on the driver, broadcast as arrays of a
bounded size, and walked by many texts at a time: texts are cut in pieces that overlap by the longest alias less one character, and
all pieces of a slice take each step together. A node's aliases, its own and those of its suffixes, are listed once.
Hits become mentions by the rules of `mentions`: whole words by the characters around, the gate by any indicator hit in the text,
and of an entity's aliases the first that fires. A slice has a bounded number of characters, and hits are taken up a bounded number at a time,
of which each text's distinct aliases stay: memory follows neither a text's length (but for its characters) nor how often aliases occur.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..shipping import bounded
from ..staging import free_prefix
from .mentions import INDICATOR_WEIGHT, Alias, Entity

#: Cells of the table, 4 bytes each, that are broadcast at most; a dictionary beyond it is refused.
CELLS = 1 << 26
#: Characters of a piece of text.
PIECE = 4_096
#: Characters of the pieces that are walked at once, about; more than a batch of bounded bytes has, unless a text is longer.
SLICE = 1 << 22
#: Hits that are taken up at once, about.
HITS = 1 << 19


def _word_table() -> np.ndarray:
    """For each code point whether it is a letter, a number or an underscore."""
    return np.fromiter((unicodedata.category(chr(i))[0] in "LN" for i in range(0x110000)), bool, 0x110000) | (np.arange(0x110000) == ord("_"))


_WORDS: list[np.ndarray] = []


def _runs(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of neighbours whose sizes add up to `most` at most, or of a single one."""
    total, at = np.append(0, np.cumsum(sizes)), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        yield slice(at, to)
        at = to


class Automaton:
    """Aliases as (entity's place, alias's place, string, mode, weight), and the table that finds them."""

    def __init__(self, aliases: Iterable[tuple[int, int, str, str, float]]):
        self.aliases = [(e, k, s, m, w) for e, k, s, m, w in aliases]
        needles: dict[str, list[int]] = {}
        for i, (_, _, s, _, _) in enumerate(self.aliases):
            needles.setdefault(s.lower(), []).append(i)
        chars = sorted({ord(c) for n in needles for c in n})
        self.longest = max(map(len, needles), default=0)
        self.chars = np.array(chars, np.uint32)
        code = {c: i + 1 for i, c in enumerate(chars)}  # 0 is any other character
        children, found, parents = [{}], [[]], [(0, 0)]
        for needle, ids in needles.items():
            node = 0
            for c in needle:
                k = code[ord(c)]
                if k not in children[node]:
                    children[node][k] = len(children)
                    parents.append((node, k))
                    children.append({})
                    found.append([])
                node = children[node][k]
            found[node] = ids
        if len(children) * (len(chars) + 1) > CELLS:
            raise ValueError(f"a dictionary of {len(children)} nodes and {len(chars)} characters has a table of more than {CELLS} cells")
        self._fill(children, found)

    def _fill(self, children: list[dict[int, int]], found: list[list[int]]) -> None:
        """The table level by level: a node's row is that of its longest proper suffix, with its own children put in."""
        table, suffix, level = np.zeros((len(children), len(self.chars) + 1), np.int32), [0] * len(children), [0]
        while level:
            deeper = []
            for node in level:
                if node:
                    table[node] = table[suffix[node]]
                    found[node] = found[node] + found[suffix[node]]
                for k, child in children[node].items():
                    suffix[child] = int(table[node, k])  # where the suffix goes on, before the child stands in its place
                    table[node, k] = child
                    deeper.append(child)
            level = deeper
        self.table, self.width = table.reshape(-1), table.shape[1]
        counts = np.array([len(f) for f in found], np.int64)
        self.starts, self.found = np.append(0, np.cumsum(counts)), np.array([i for f in found for i in f], np.int64)
        self.lengths = np.array([len(s.lower()) for _, _, s, _, _ in self.aliases], np.int64)
        self.whole = np.array([m == "word_boundary" for *_, m, _ in self.aliases], bool)
        self.gated = np.array([m == "requires_context" for *_, m, _ in self.aliases], bool)
        self.indicator = np.array([w >= INDICATOR_WEIGHT and m != "requires_context" for *_, m, w in self.aliases], bool)
        self.entity, self.place = (np.array([a[i] for a in self.aliases], np.int64) for i in (0, 1))
        self.ranked = np.lexsort((self.place, self.entity))
        self.rank = np.argsort(self.ranked)

    def _walk(self, points: np.ndarray, own: np.ndarray, first: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """End (exclusive, among the points) and node of the places in the pieces at which aliases end, HITS or one step's more at once."""
        slot = np.searchsorted(self.chars, points)
        slot[slot == len(self.chars)] = 0
        code = np.where(self.chars[slot] == points, slot + 1, 0).astype(np.int64)
        del slot
        order = np.argsort(first - end, kind="stable")  # the longest first, so those that go on are in front
        own, first, length = own[order], first[order], (end - first)[order]
        node, ends, nodes, held = np.zeros(len(order), np.int64), [], [], 0
        going, has = len(order), self.starts[1:] > self.starts[:-1]
        for step in range(int(length[0])):
            while length[going - 1] <= step:
                going -= 1
            at = first[:going] + step
            node[:going] = now = self.table[node[:going] * self.width + code[at]]
            hit = np.flatnonzero(has[now] & (at >= own[:going]))
            ends.append(at[hit] + 1)
            nodes.append(now[hit])
            held += len(hit)
            if held >= HITS:
                yield np.concatenate(ends), np.concatenate(nodes)
                ends, nodes, held = [], [], 0
        if held:
            yield np.concatenate(ends), np.concatenate(nodes)

    def _parts(self, points: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """`hits`, HITS or one place's at most at once."""
        # pieces, each from `first` to `end`, and hits count from `own` on
        sizes = np.diff(offsets)
        pieces = -(-sizes // PIECE)
        of = np.repeat(np.arange(len(sizes)), pieces)
        own = offsets[of] + PIECE * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        first, end = np.maximum(own - (self.longest - 1), offsets[of]), np.minimum(own + PIECE, offsets[of + 1])
        for run in _runs(end - first, SLICE):
            base = first[run][0]
            for ends, nodes in self._walk(points[base : end[run][-1]], own[run] - base, first[run] - base, end[run] - base):
                n = self.starts[nodes + 1] - self.starts[nodes]
                for part in _runs(n, HITS):
                    m = n[part]
                    places = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(self.starts[nodes[part]], m)
                    yield np.repeat(ends[part] + base, m), self.found[places]

    def hits(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """End (exclusive, among all points) and alias of every occurrence in the texts."""
        none = np.zeros(0, np.int64)
        ends, aliases = zip((none, none), *self._parts(points, offsets), strict=True)
        return np.concatenate(ends), np.concatenate(aliases)

    def mentions(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Text and alias of each mention in lowered texts, ordered by text and entity."""
        if not self.aliases:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not _WORDS:
            _WORDS.append(_word_table())
        word = _WORDS[0]
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.append(0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))))
        gate = np.zeros(len(texts), bool)
        found, held, most = [np.zeros(0, np.int64)], 0, HITS  # texts with the ranks of aliases that fire, or do if the text has the gate
        for end, alias in self._parts(points, offsets):
            text = np.searchsorted(offsets, end, "left") - 1  # an end belongs to the text that it is in or closes
            gate[text[self.indicator[alias]]] = True
            # a boundary beside a character: the one outside is of the other kind, and the ends of a text are no word characters
            whole = np.flatnonzero(self.whole[alias])
            last, start, of = end[whole], end[whole] - self.lengths[alias[whole]], text[whole]
            before = (start > offsets[of]) & word[points[np.maximum(start - 1, 0)]]
            after = (last < offsets[of + 1]) & word[points[np.minimum(last, len(points) - 1)]]
            fires = np.ones(len(end), bool)
            fires[whole] = (before != word[points[start]]) & (after != word[points[last - 1]])
            found.append(np.unique(text[fires] * len(self.aliases) + self.rank[alias[fires]]))
            held += len(found[-1])
            if held > most:
                found = [np.unique(np.concatenate(found))]
                held, most = len(found[0]), max(HITS, 2 * len(found[0]))
        found = np.unique(np.concatenate(found))
        text, alias = found // len(self.aliases), self.ranked[found % len(self.aliases)]
        fires = ~self.gated[alias] | gate[text]
        text, alias = text[fires], alias[fires]
        first = np.append(True, (text[1:] != text[:-1]) | (self.entity[alias[1:]] != self.entity[alias[:-1]]))[: len(text)]
        return text[first], alias[first]


def of_entities(entities: Sequence[Entity]) -> tuple[Automaton, list[str]]:
    return Automaton((e, k, a.string, a.mode, a.weight) for e, entity in enumerate(entities) for k, a in enumerate(entity.aliases)), [e.id for e in entities]


def of_table(aliases: DataFrame) -> tuple[Automaton, list[str]]:
    """From a dictionary in a table (character_id, pos, alias, mode, weight), which must be small enough for an automaton."""
    rows = aliases.select("character_id", "pos", "alias", "mode", "weight").limit(CELLS // 16 + 1).collect()
    if len(rows) > CELLS // 16:
        raise ValueError(f"a dictionary of more than {CELLS // 16} aliases")
    ids = sorted({r.character_id for r in rows})
    place = {c: i for i, c in enumerate(ids)}
    for r in rows:
        Alias(r.alias, r.mode, r.weight)  # checks it
    return Automaton((place[r.character_id], r.pos, r.alias, r.mode, float(r.weight)) for r in rows), ids


def mentions_by_automaton(df: DataFrame, text: Column, dictionary: Sequence[Entity] | DataFrame, keep: Sequence[str]) -> DataFrame:
    """What `with_mentions` gives, for dictionaries of tens of thousands of aliases: keep, character_id, alias_matched, mention_weight.

    Null and empty texts mention nothing. The walk's cost follows the texts' characters and not the number of aliases.
    """
    spark = bounded(df.sparkSession)
    machine, ids = of_table(dictionary) if isinstance(dictionary, DataFrame) else of_entities(dictionary)
    shared = spark.sparkContext.broadcast((machine, ids))
    p = free_prefix(df, "automaton_")
    rows = df.select(F.lower(F.coalesce(text, F.lit(""))).alias(f"{p}text"), *keep)
    schema = T.StructType([*[rows.schema[c] for c in keep], *T.StructType.fromDDL("character_id string, alias_matched string, mention_weight double")])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, ids = shared.value
        for batch in batches:
            at, alias = machine.mentions(batch.column(0).to_pylist())
            found = [machine.aliases[i] for i in alias.tolist()]
            columns = [batch.column(i + 1).take(pa.array(at)) for i in range(len(keep))]
            columns += [pa.array([ids[a[0]] for a in found], pa.string()), pa.array([a[2] for a in found], pa.string()), pa.array([float(a[4]) for a in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(find, schema)
