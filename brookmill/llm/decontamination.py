"""Benchmark decontamination by canonical templates.

Texts become template tokens: numbers, units that follow a number or stand with it, and names
(runs of capitalised words inside a sentence) turn into typed placeholders; other words are
lower-cased and lose punctuation around them. Windows of `seed` tokens are hashed, of the
template and also of the plain words (where names stay words, so that a passage in other case is
found too), and looked up among the windows of the benchmark items. A window with over three
placeholders of five is looked up by its literal values instead.

Where a window is found, item and document are compared token by token at that offset, for runs of
`seed` tokens or more: by literal values, and by template, where slots have to agree: the same
value in the item must stand for one value in the document; slots that break this end a run. Runs
of `window` tokens count wherever they stand, shorter ones where they form a chain in the item's
order, with gaps no longer than the item. A document leaks an item if these cover `coverage` of
the item's tokens and `window` tokens at least (half of them words), or if `run` tokens in a row are
verbatim. Where all slots keep their values the leak is verbatim, else it is re-parameterised.

The benchmark is the stated query set: its items go to the workers in blocks of about
`block_tokens` words, and each block is held against every document in one scan.

Nulls and edges: null and empty texts, of documents or items, match nothing; an item shorter
than the window must be there whole, and under `least` tokens it is left alone; repeated rows and items
are each reported; whole texts count, however long. Extra columns pass through `with_leaks`, which
replaces one named leaks, and `drop_leaks`, which changes none.
"""

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, mix64, whole_rows, words_of

WINDOW, SEED, RUN, LEAST, COVERAGE, BLOCK_TOKENS = 8, 5, 13, 4, 0.5, 1_000_000
#: Characters of documents that are held against the items at once; each takes about 40 bytes of arrays.
SLICE_CHARS = 1 << 20
WORD, NUMBER, UNIT, NAME = range(4)
PLAIN, TEMPLATE = range(2)
#: Units of measure and currency, and small numbers as words.
UNITS = frozenset("% $ € £ ° mm cm m km mg g kg t lb lbs oz ml l h hr hrs min mins s sec secs ms mph kmh inch inches foot feet yard yards mile miles meter meters metre metres gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent degrees".split())
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split())
#: ASCII characters that are neither letters nor digits.
_AROUND = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
#: Words of ASCII without digits and of the letters of Latin-1.
_SIMPLE = "^[\\x00-/:-\\x7F\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+$"
_PART = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[%$€£°]")


def _parts(word: str) -> list[tuple[int, str, bool]]:
    """(kind, lower-cased value, capitalised) of the template tokens of one word; UNIT only says that it may be one."""
    if word.isalpha():
        found = [word]
    elif any(c.isdigit() for c in word):
        found = _PART.findall(word)
    else:
        core = re.sub(r"^[\W_]+|[\W_]+$", "", word)
        found = [core] if core else [c for c in word if c in UNITS]
    out = []
    for x in found:
        low = x.lower()
        kind = NUMBER if x[0].isdigit() or low in NUMBERS else UNIT if low in UNITS else WORD
        out.append((kind, low, x[:1].isupper()))
    return out


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def _read(words: pa.Array) -> tuple[np.ndarray, ...]:
    """How many template tokens each word has; kind, capitalised and value hash of all these in a row.

    Words of _SIMPLE that hold a letter have one token each and are read as columns, the others one by one.
    """
    core = pc.utf8_trim(words, _AROUND)
    simple = pc.and_(pc.match_substring_regex(words, _SIMPLE), pc.not_equal(core, ""))
    core, rest = core.filter(simple), [_parts(w) for w in words.filter(pc.invert(simple)).to_numpy(zero_copy_only=False)]
    simple = simple.to_numpy(zero_copy_only=False)
    n = np.ones(len(words), dtype=np.int64)
    n[~simple] = np.fromiter(map(len, rest), dtype=np.int64, count=len(rest))
    single = np.repeat(simple, n)

    low = pc.utf8_lower(core)
    of = lambda values: pc.is_in(low, pa.array(sorted(values))).to_numpy(zero_copy_only=False)
    kinds, caps, hashes = np.zeros(len(single), dtype=np.int8), np.zeros(len(single), dtype=bool), np.zeros(len(single), dtype=np.uint64)
    kinds[single] = np.where(of(NUMBERS), NUMBER, np.where(of(UNITS), UNIT, WORD))
    caps[single] = pc.utf8_is_upper(pc.utf8_slice_codeunits(core, 0, 1)).to_numpy(zero_copy_only=False)
    hashes[single] = np.fromiter(map(xxhash.xxh64_intdigest, low.cast(pa.binary()).to_numpy(zero_copy_only=False)), dtype=np.uint64, count=len(low))
    every = [p for ps in rest for p in ps]
    kinds[~single], caps[~single], hashes[~single] = [p[0] for p in every], [p[2] for p in every], np.fromiter((_hash(p[1]) for p in every), dtype=np.uint64, count=len(every))
    return n, kinds, caps, hashes


class Tokens:
    """Template tokens of several texts in a row: arrays of kind, value hash, text and template hash."""

    def __init__(self, texts: list[str | None]):
        flat, ends = words_of(pa.array(texts, pa.string()), lower=False)
        coded = flat.dictionary_encode()
        known, at = coded.dictionary, coded.indices.to_numpy()
        n, kinds, caps, hashes = _read(known)
        first = np.append(0, np.cumsum(n))
        stops = pc.match_substring_regex(known, "[.!?:][\"')\\]»”]*$").to_numpy(zero_copy_only=False)

        counts = n[at]
        source = np.repeat(np.arange(len(at)), counts)
        inner = np.arange(len(source)) - np.repeat(np.cumsum(counts) - counts, counts)
        ids = first[at][source] + inner
        text = np.repeat(np.arange(len(texts)), np.diff(ends))[source]
        fresh = np.append(True, stops[at[:-1]]) if len(at) else np.zeros(0, dtype=bool)
        fresh[ends[:-1][ends[:-1] < len(at)]] = True

        kind = kinds[ids] if len(ids) else np.zeros(0, dtype=np.int8)
        number = kind == NUMBER
        beside = np.zeros(len(kind), dtype=bool)
        beside[1:] |= number[:-1] & (text[1:] == text[:-1])
        beside[:-1] |= number[1:] & (source[1:] == source[:-1])
        kind = np.where((kind == UNIT) & ~beside, WORD, kind)
        name = (kind == WORD) & caps[ids] & ~fresh[source] if len(ids) else np.zeros(0, dtype=bool)
        self.text, self.kind, self.name, self.value, self.place = text, kind, name, hashes[ids] if len(ids) else np.zeros(0, dtype=np.uint64), source - (ends[text] if len(text) else 0)

    def plain(self) -> tuple[np.ndarray, ...]:
        """text, kind, value, place of tokens with names as words."""
        return self.text, self.kind, self.value, self.place

    def template(self) -> tuple[np.ndarray, ...]:
        """The same with each run of names as one token, its value that of the whole run."""
        follows = np.append(False, self.name[1:] & self.name[:-1] & (self.text[1:] == self.text[:-1])) if len(self.name) else self.name
        keep = ~follows
        value = self.value
        if len(value):
            run = np.cumsum(keep) - 1
            value = np.zeros(keep.sum(), dtype=np.uint64)
            with np.errstate(over="ignore"):
                np.add.at(value, run, mix64(self.value + (np.arange(len(run)) - np.flatnonzero(keep)[run]).astype(np.uint64)) if follows.any() else self.value)
                if follows.any():
                    alone = np.bincount(run) == 1
                    value[alone] = self.value[keep][alone]
        return self.text[keep], np.where(self.name, NAME, self.kind)[keep], value, self.place[keep]


def _codes(kind: np.ndarray, value: np.ndarray) -> np.ndarray:
    return np.where(kind == WORD, value, kind.astype(np.uint64))


def _windows(text: np.ndarray, kind: np.ndarray, value: np.ndarray, width: int, form: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the window that starts at each token, and whether it lies in one text and may be looked up."""
    n = len(text) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    token = _codes(kind, value)
    out = np.full(n, form * 131 + width, dtype=np.uint64)
    slots = np.append(0, np.cumsum(kind != WORD))
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + token[k : k + n]
    usable = text[:n] == text[width - 1 :]
    vague = slots[width:] - slots[:-width] > width // 2 + 1
    if form == TEMPLATE:
        return mix64(out), usable & ~vague
    at = np.flatnonzero(vague)
    if len(at):
        literal = np.full(len(at), 977 + width, dtype=np.uint64)
        for k in range(width):
            literal = literal * np.uint64(0x9E3779B97F4A7C15) + value[at + k]
        out[at] = literal
    return mix64(out), usable


def _runs(same: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Start and end of the runs of at least `least` true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
    return [(a, b) for a, b in edge.reshape(-1, 2).tolist() if b - a >= least]


def _chain(runs: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """The runs (item start, item end, text start) of the chain that covers most of the item, both orders kept, overlaps cut."""
    runs = sorted(runs, key=lambda r: (r[2], r[0]))
    q0, q1, p0 = np.array(runs, dtype=np.int64).T
    p1, best, back, low = p0 + q1 - q0, q1 - q0, np.full(len(runs), -1), 0
    best = best.copy()
    longest = int((q1 - q0).max())
    for i in range(len(runs)):
        while p0[low] + longest + gap < p0[i]:
            low += 1
        if low == i:
            continue
        j = np.arange(low, i)
        j = j[(q0[j] < q0[i]) & (p0[j] < p0[i]) & (p0[i] - p1[j] <= gap)]
        own = q1[i] - q0[i] - np.maximum(0, np.maximum(q1[j] - q0[i], p1[j] - p0[i]))
        j, own = j[own > 0], own[own > 0]
        if len(j):
            k = int(np.argmax(best[j] + own))
            if best[j[k]] + own[k] > best[i]:
                best[i], back[i] = best[j[k]] + own[k], j[k]
    at, out = int(np.argmax(best)), []
    while at >= 0:
        out.append(runs[at])
        at = int(back[at])
    return out


class Index:
    """The windows of a block of items."""

    def __init__(self, texts: list[str | None], window: int, seed: int, run: int, least: int):
        self.window, self.seed, self.run = window, seed, run
        tokens = Tokens(texts)
        self.forms = (tokens.plain(), tokens.template())
        self.codes = [_codes(kind, value) for _, kind, value, _ in self.forms]
        self.bounds = [np.append(0, np.cumsum(np.bincount(f[0], minlength=len(texts)))) for f in self.forms]
        rows = []
        for form, (text, kind, value, _) in enumerate(self.forms):
            sizes = np.bincount(text, minlength=len(texts))
            for width in sorted({min(seed, int(s)) for s in sizes if s >= least}):
                hashes, usable = _windows(text, kind, value, width, form)
                own = np.minimum(sizes[text[: len(hashes)]], seed) == width
                at = np.flatnonzero(usable & own)
                rows.append(np.stack([hashes[at], at.astype(np.uint64), np.full(len(at), form, dtype=np.uint64), np.full(len(at), width, dtype=np.uint64)], axis=1))
        rows = np.concatenate(rows) if rows else np.zeros((0, 4), dtype=np.uint64)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 2], rows[:, 0]))]
        self.hashes, self.at, self.form = rows[:, 0], rows[:, 1].astype(np.int64), rows[:, 2].astype(np.int64)
        self.lookups = sorted({(int(f), int(w)) for f, w in rows[:, 2:]})
        self.sieve = np.zeros(1 << 20, dtype=bool)
        self.sieve[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def leaks(self, texts: list[str | None], coverage: float) -> list[list[tuple]]:
        """For each text its leaks: (item, coverage, verbatim, first word, last word)."""
        tokens = Tokens(texts)
        forms = (tokens.plain(), tokens.template())
        hits: dict[tuple, set] = defaultdict(set)
        for form, width in self.lookups:
            text, kind, value, _ = forms[form]
            hashes, usable = _windows(text, kind, value, width, form)
            at = np.flatnonzero(usable & self.sieve[(hashes >> np.uint64(44)).astype(np.int64)])
            low, high = (np.searchsorted(self.hashes, hashes[at], side=s) for s in ("left", "right"))
            for p, a, b in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
                for q in self.at[a:b][self.form[a:b] == form].tolist():
                    hits[int(text[p]), int(self.forms[form][0][q]), form].add(p - q)
        bounds = [np.append(0, np.cumsum(np.bincount(f[0], minlength=len(texts)))) for f in forms]
        found: dict[tuple, tuple] = {}
        for (doc, item, form), offsets in hits.items():
            for literal in (False, True) if form == PLAIN else (False,):
                got = self._held(forms[form], bounds[form], doc, item, form, offsets, literal, coverage)
                if got and got[:2] > found.get((doc, item), (0, False))[:2]:
                    found[doc, item] = got
        out: list[list[tuple]] = [[] for _ in texts]
        for (doc, item), rest in sorted(found.items()):
            out[doc].append((item, *rest))
        return out

    def _held(self, tokens: tuple, bounds: np.ndarray, doc: int, item: int, form: int, offsets: set, literal: bool, coverage: float) -> tuple | None:
        """The leak (coverage, verbatim, first word, last word) of the item at these offsets, if there is one."""
        start, end = int(self.bounds[form][item]), int(self.bounds[form][item + 1])
        size = end - start
        whole = min(self.window, size)
        runs, kept_values = [], {}
        for d in offsets:
            low, high = max(start, int(bounds[doc]) - d), min(end, int(bounds[doc + 1]) - d)
            own, kept_values[d] = self._agreeing(tokens, form, d, low, high, min(self.seed, size), literal)
            runs += [(a - start, b - start, a + d) for a, b in own]
        if not runs:
            return None
        used = {r for r in runs if r[1] - r[0] >= whole} | set(_chain(runs, size))
        covered = np.zeros(size, dtype=bool)
        for a, b, _ in used:
            covered[a:b] = True
        n = int(covered.sum())
        words = n if literal else int((self.forms[form][1][start:end][covered] == WORD).sum())
        if not (n >= whole and n >= coverage * size and 2 * words >= whole) and not (literal and max(b - a for a, b, _ in runs) >= self.run):
            return None
        place = tokens[3]
        verbatim = all(kept_values[p - a - start] for a, _, p in used)
        return n / size, verbatim, min(int(place[p]) for _, _, p in used), max(int(place[p + b - a - 1]) for a, b, p in used)

    def _agreeing(self, tokens: tuple, form: int, d: int, low: int, high: int, least: int, literal: bool) -> tuple[list, bool]:
        """Runs of the item's tokens low to high that agree with the text's d further on, and whether their slots keep their values."""
        _, kind, value, _ = tokens
        kind, value, item_value = kind[low + d : high + d], value[low + d : high + d], self.forms[form][2][low:high]
        same = value == item_value if literal else _codes(kind, value) == self.codes[form][low:high]
        runs = _runs(same, least)
        if not literal:
            slots = [k for a, b in runs for k in range(a, b) if kind[k] != WORD]
            votes: dict[tuple, Counter] = defaultdict(Counter)
            for k in slots:
                votes[int(kind[k]), int(item_value[k])][int(value[k])] += 1
            chosen = {k: min(c, key=lambda v: (-c[v], v)) for k, c in votes.items()}
            broken = [k for k in slots if chosen[int(kind[k]), int(item_value[k])] != int(value[k])]
            if broken:
                same[broken] = False
                runs = _runs(same, least)
        kept = all(value[k] == item_value[k] for a, b in runs for k in range(a, b))
        return [(a + low, b + low) for a, b in runs], kept


def with_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, seed: int = SEED, run: int = RUN, least: int = LEAST, coverage: float = COVERAGE, block_tokens: int = BLOCK_TOKENS, text: str = "text") -> DataFrame:
    """docs with leaks: an array of (item_id, coverage, verbatim, first_word, last_word)."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    schema = f"array<struct<item_id:{kind},coverage:double,verbatim:boolean,first_word:long,last_word:long>>"
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // (block_tokens * 6)))
    block = F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks))

    def scan(sent):
        @F.pandas_udf(schema)
        def leaks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            ids, texts = sent.value
            index = Index(texts, window, seed, run, least)
            for batch in batches:
                out, start = [], 0
                ends = np.cumsum([len(t or "") for t in batch])
                while start < len(batch):
                    base = ends[start - 1] if start else 0
                    stop = max(start + 1, int(np.searchsorted(ends, base + SLICE_CHARS, side="right")))
                    out += index.leaks(list(batch.iloc[start:stop]), coverage)
                    give_back()
                    start = stop
                yield pd.Series([[(ids[i], *rest) for i, *rest in row] for row in out], dtype=object)

        return leaks(F.col(text))

    found = []
    for b in range(blocks):
        rows = sorted(items.select("item_id", "text").where(block == b).collect(), key=lambda r: (r.item_id is None, r.item_id, r.text or ""))
        found.append(scan(spark.sparkContext.broadcast(([r.item_id for r in rows], [r.text for r in rows]))))
    return docs.withColumn("leaks", F.concat(*found))


def find_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, coverage, verbatim, first_word, last_word: one row for each document and item that it leaks."""
    return with_leaks(docs.select("doc_id", "text"), items, **options).select("doc_id", F.inline("leaks"))


def drop_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without those that leak an item."""
    return with_leaks(whole_rows(docs), items, **options | {"text": f"row.{options.get('text', 'text')}"}).where(F.size("leaks") == 0).select("row.*")
