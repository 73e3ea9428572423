"""Spelling variants: words that differ by one code point, found by composing finite automata.

The pairs are the accepted pairs of *A o T o A*: A the minimised acceptor of the vocabulary, T the transducer that copies
its input but for one inserted, deleted or replaced code point.  A path of the composition reads the same code points on
both sides, makes its edit, and reads the same again, so of two near words at least one half of the shorter is read
without an edit.  The composition is therefore dealt by the state it is in after half a word: a partition holds the words
of one length, and of one more, that begin with the same half; the mirror image of the vocabulary gives the pairs whose
edit lies in the first half.  Each partition builds its own part of the acceptor and enumerates its accepted pairs; each
pair is accepted in exactly one partition.  No task holds the vocabulary.

A partition of over ``group_words`` words goes on one code point further: the pairs that make their edit right here are
accepted in partitions of the words that share all but this code point (no more than letters exist), all others behind the
next state.  That repeats until no partition is too large, so the result does not depend on the limit.

The vocabulary is counted with one bounded table a task and summed by Spark.  A pair leaves its partition only as a count
and the best partner of either word.  Forms are followed to their roots by pointer jumping, in rounds of one join; each
step doubles the count at least, so there are few.

Defined cases.  A null or empty text has no words.  A null id is written as nothing before the colon.  Repeated rows count
again.  A text of any length is read in pieces that end between words; only a single run is never cut.  Of near words with
the same count the smallest in code-point order is the form.  An empty table gives no rows; other columns play no part and
may have any name.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, bounded_batches, stored

_RUN = re.compile("[a-zÀ-ÿ]+")
_GAP = re.compile("[^a-zÀ-ÿ]")
_LOWER = bytes(LOWER.tolist())
_PIECE = 1 << 20


@dataclass(frozen=True)
class SpellingRules:
    """``drop_every``: of so many (document, run) pairs one loses a code point, by its checksum (0: none)."""

    min_chars: int = 5
    min_count: int = 3
    ratio: int = 2
    drop_every: int = 97
    group_words: int = 20_000


def pieces(text: str) -> Iterator[str]:
    """The text in parts of about a million code points that end between runs."""
    at = 0
    while len(text) - at > _PIECE:
        gap = _GAP.search(text, at + _PIECE)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def document_words(id: object, text: str, rules: SpellingRules, into: Counter) -> None:
    """Count the words of one document into ``into``."""
    lowered = text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")
    start = zlib.crc32(f"{'' if id is None else id}:".encode())
    for part in pieces(lowered):
        for word, n in Counter(_RUN.findall(part)).items():
            if rules.drop_every:
                h = zlib.crc32(word.encode(), start)
                if not h % rules.drop_every:
                    at = h % len(word)
                    word = word[:at] + word[at + 1:]
            if len(word) >= rules.min_chars:
                into[word] += n


def vocabulary(docs: DataFrame, rules: SpellingRules = SpellingRules(), id: str = "doc_id", text: str = "text",
               held: int = 100_000) -> DataFrame:
    """``(word, n)`` of the words that are long and frequent enough."""
    bounded_batches(docs.sparkSession)

    def rows(count: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(count.keys(), pa.string()), "n": pa.array(count.values(), pa.int64())})

    def run(batches):
        count: Counter = Counter()
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for i in range(b.num_rows):
                if texts[i].is_valid:
                    document_words(ids[i].as_py(), texts[i].as_py(), rules, count)
                    if len(count) > held:
                        yield rows(count)
                        count.clear()
        yield rows(count)

    read = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    counted = read.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= rules.min_count)


class Acceptor:
    """A minimal acyclic acceptor; several languages share their states, each has a root of its own."""

    def __init__(self):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.known: dict[tuple, int] = {}
        self.language: dict[int, list[str]] = {}

    def state(self, arcs: dict[str, int], final: bool) -> int:
        key = (final, *arcs.items())
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
        return found

    def add(self, words: list[str]) -> int:
        """Root of the acceptor of some sorted, distinct words: states that nothing can be added to are merged at once."""
        path: list[list] = [[{}, False]]
        before = ""
        for word in [*words, ""]:
            same = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                same += 1
            while len(path) - 1 > same:
                done = path.pop()
                path[-1][0][before[len(path) - 1]] = self.state(*done)
            for _ in word[same:]:
                path.append([{}, False])
            path[-1][1] = path[-1][1] or bool(word)
            before = word
        path[0][1] = words[:1] == [""]
        return self.state(*path[0])

    def words(self, root: int) -> list[str]:
        """All words from a state."""
        found = self.language.get(root)
        if found is None:
            found, todo = [], [(root, "")]
            while todo:
                s, read = todo.pop()
                if self.final[s]:
                    found.append(read)
                todo.extend((t, read + c) for c, t in self.arcs[s].items())
            self.language[root] = found
        return found

    def common(self, p: int, q: int, but: str) -> Iterator[str]:
        """Words that are accepted from both states, without those that begin with ``but``: the copying half of T."""
        arcs, final = self.arcs, self.final
        todo = [(p, q, "")]
        while todo:
            p, q, read = todo.pop()
            if p == q and not (but and not read):
                for rest in self.words(p):
                    yield read + rest
                continue
            if final[p] and final[q]:
                yield read
            mine, theirs = arcs[p], arcs[q]
            if len(theirs) < len(mine):
                mine, theirs = theirs, mine
                for c, t in mine.items():
                    if c in theirs and (read or c != but):
                        todo.append((theirs[c], t, read + c))
            else:
                for c, t in mine.items():
                    if c in theirs and (read or c != but):
                        todo.append((t, theirs[c], read + c))

    def replaced(self, root: int) -> Iterator[tuple[str, str]]:
        """Pairs of a language that differ by one replaced code point."""
        todo = [(root, "")]
        while todo:
            s, read = todo.pop()
            arcs = list(self.arcs[s].items())
            for i, (a, p) in enumerate(arcs):
                for b, q in arcs[i + 1:]:
                    for rest in self.common(p, q, ""):
                        yield read + a + rest, read + b + rest
                todo.append((p, read + a))

    def inserted(self, short: int, long: int) -> Iterator[tuple[str, str, bool]]:
        """Pairs of a word of the first language and one of the second with one code point more.  The edit comes as late
        as it can, so a pair is accepted once; the third value tells that it is the very last code point."""
        todo = [(short, long, "")]
        while todo:
            p, q, read = todo.pop()
            mine = self.arcs[p]
            for c, t in self.arcs[q].items():
                for rest in self.common(p, t, c):
                    yield read + rest, read + c + rest, not rest
                if c in mine:
                    todo.append((mine[c], t, read + c))


def near_in_group(head: str, tail: str, back: bool, short: dict[str, int], long: dict[str, int]) -> dict[str, list]:
    """Of the near pairs of one partition: ``word: [near words, best count, best word]``."""
    machine, out = Acceptor(), {}
    whole = len(head) + len(tail)

    def note(x: str, n: int, y: str, m: int) -> None:
        got = out.get(x)
        if got is None:
            out[x] = [1, m, y]
        else:
            got[0] += 1
            if m > got[1] or m == got[1] and y < got[2]:
                got[1:] = m, y

    def pair(a: str, n: int, b: str, m: int) -> None:
        x, y = head + a + tail, head + b + tail
        if back:
            x, y = x[::-1], y[::-1]
            # the first half of the shorter word is equal: that pair is accepted on the other side
            half = (whole + len(a)) // 2
            if x[:half] == y[:half]:
                return
        note(x, n, y, m)
        note(y, m, x, n)

    first = machine.add(sorted(short))
    for a, b in machine.replaced(first):
        pair(a, short[a], b, short[b])
    if long:
        second = machine.add(sorted(long))
        for a, b, last in machine.inserted(first, second):
            if not (last and tail and tail[0] == b[-1]):
                pair(a, short[a], b, long[b])
    return out


def _groups(words: DataFrame, rules: SpellingRules) -> DataFrame:
    """``(back, m, head, tail, rest, long, n)``: each word in the partitions where it can be near another."""
    size = F.length("word")
    both = words.withColumn("back", F.explode(F.array(F.lit(False), F.lit(True))))
    both = both.withColumn("word", F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word")))
    both = both.withColumn("long", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("m", size - F.col("long").cast("int"))
    half = F.floor(F.col("m") / 2).cast("int")
    # the shorter word of a pair is a word itself, so it has the least number of code points
    rows = both.where(F.col("m") >= rules.min_chars).select(
        "back", "m", F.substring("word", F.lit(1), half).alias("head"), F.lit("").alias("tail"),
        F.substring("word", half + 1, size).alias("rest"), "long", "n")
    key = ["back", "m", "head"]
    done, rows = [], stored(rows, "halves")
    while True:
        large = stored(rows.groupBy(*key).count().where(F.col("count") > rules.group_words).drop("count"), "large")
        if not large.take(1):
            break
        done.append(rows.join(large, key, "left_anti"))
        hot = rows.join(large, key)
        first, rest = F.substring("rest", 1, 1), F.substring("rest", F.lit(2), F.length("rest"))
        none = F.lit("")
        part = lambda h, r, t: F.struct(h.alias("head"), r.alias("rest"), t.alias("tail"))
        here = F.when(F.col("long"), F.array(part(F.col("head"), first, rest))).when(
            F.col("rest") == "", F.array(part(F.col("head"), none, none))).otherwise(
            F.array(part(F.col("head"), first, rest), part(F.col("head"), none, F.col("rest"))))
        columns = hot.withColumn("p", F.explode(here)).select("back", "m", "p.head", "p.tail", "p.rest", "long", "n")
        done.append(stored(columns, "columns"))
        rows = stored(hot.where("rest <> ''").select(
            "back", "m", F.concat("head", first).alias("head"), "tail", rest.alias("rest"), "long", "n"), "halves")
    for d in done:
        rows = rows.unionByName(d)
    return rows


def near_words(words: DataFrame, rules: SpellingRules = SpellingRules()) -> DataFrame:
    """``(word, n_near, best)`` of every word of ``words(word, n)`` with a near word; ``best`` is ``(-count, word)``."""
    key = ["back", "m", "head", "tail"]

    def run(batches):
        now, short, long = None, {}, {}
        out: dict[str, list] = {"word": [], "n_near": [], "best_n": [], "best": []}

        def close():
            if short and len(short) + len(long) > 1:
                for word, (n, m, best) in near_in_group(now[2], now[3], now[0], short, long).items():
                    out["word"].append(word)
                    out["n_near"].append(n)
                    out["best_n"].append(m)
                    out["best"].append(best)

        def flush():
            batch = pa.RecordBatch.from_pydict({"word": pa.array(out["word"], pa.string()), "n_near": pa.array(out["n_near"], pa.int64()),
                                                "best_n": pa.array(out["best_n"], pa.int64()), "best": pa.array(out["best"], pa.string())})
            for values in out.values():
                values.clear()
            return batch

        for b in batches:
            for back, m, head, tail, rest, is_long, n in zip(*(c.to_pylist() for c in b.columns)):
                if (back, m, head, tail) != now:
                    close()
                    now, short, long = (back, m, head, tail), {}, {}
                (long if is_long else short)[rest] = n
            if len(out["word"]) > 10_000:
                yield flush()
        close()
        yield flush()

    dealt = _groups(words, rules).select(*key, "rest", "long", "n").repartition(*key).sortWithinPartitions(*key)
    found = dealt.mapInArrow(run, "word string, n_near long, best_n long, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best"))


def variants(docs: DataFrame, rules: SpellingRules = SpellingRules(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` of every word of the vocabulary."""
    bounded_batches(docs.sparkSession)
    words = stored(vocabulary(docs, rules, id, text), "vocabulary")
    near = near_words(words, rules).withColumnRenamed("word", "_word")
    best = -F.col("best.n")
    good = best >= rules.ratio * F.col("n")
    table = stored(words.join(near, F.col("word") == F.col("_word"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.word")).alias("form"),
        F.when(good, best).alias("form_n")), "forms")
    links = table.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = links.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        after = stored(links.join(ahead, F.col("root") == F.col("_w"), "left").select(
            "word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "roots")
        links = after.drop("moved")
        if not after.where("moved").take(1):
            break
    roots = links.withColumnRenamed("word", "_word")
    return table.join(roots, F.col("word") == F.col("_word"), "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
