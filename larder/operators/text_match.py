"""Regular-expression and dictionary matching over whole texts.

Match rows carry ``start``/``end`` offsets into the text (0-based, end exclusive).
Patterns run in the JVM, dictionaries over Arrow batches of lower-cased texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Container, Iterable, Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from larder.functions.binding import bind
from larder.session import cut_lineage

# Dictionary words end at anything outside this ASCII class, so accented letters separate.
WORD = "[A-Za-z0-9_]"
_DOTTED_I = "İ"  # the one letter whose lower case is longer
_MARK = ""

PIECE_ROWS = 20_000  # rows that a task builds at once
MOST_TOLD = 500_000  # words that are told to the readers of the texts
PIECE_TEXTS = 64  # texts whose matches a task holds at once
MOST_TERM_CHARS = 4_000_000  # of dictionaries that become an index in the tasks
MOST_UNTOLD = 3  # patterns that every text is tried with; of more, those that it may hold are found first


_MATCH = "raw:string,g:array<string>,start:int,end:int"
_MATCHES = f"array<struct<{_MATCH}>>"


# Noncharacters, which texts for interchange do not have: they enclose a match and its groups.
_CUT, _FIELD = "\ufdd0", "\ufdd1"


def match_parts(text: Column, pattern: str, groups: Sequence[int] = (), clash: Column | None = None) -> list[Column]:
    """Matches, each with its wanted groups behind it, and the texts between them.

    One pass of the pattern marks the matches, and the marked text is cut at the marks.
    Texts that hold a mark themselves (``clash``) are gone through once for each part.
    """
    if clash is None:
        clash = F.contains(text, F.lit(_CUT)) | F.contains(text, F.lit(_FIELD))
    marked = F.regexp_replace(text, F.lit(pattern), F.lit(_CUT + _FIELD.join(f"${g}" for g in (0, *groups)) + _CUT))

    def cut(parts: Column) -> Column:
        cells = F.transform(F.filter(parts, lambda _, i: i % 2 == 1), lambda m: F.split(m, _FIELD, -1))
        return F.struct(cells.alias("cells"), F.filter(parts, lambda _, i: i % 2 == 0).alias("gaps"))

    def zipped(columns: Column) -> Column:
        rows = F.transform(F.sequence(F.lit(1), F.size(columns[0])), lambda i: F.transform(columns, lambda c: F.element_at(c, i)))
        return F.when(F.size(columns[0]) > 0, rows).otherwise(F.array().cast("array<array<string>>"))

    each = F.array(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, *groups)])
    slow = F.struct(bind(each, zipped).alias("cells"), F.split(text, pattern, -1).alias("gaps"))
    return [F.when(clash, slow).otherwise(bind(F.split(marked, _CUT, -1), cut)).alias("parts")]


def located(p: Column) -> Column:
    """Matches of ``match_parts`` with offsets.

    Spark returns match texts but no offsets; offsets are running lengths of the matches
    and of the texts between them.
    """
    cells, gaps = p["parts"]["cells"], p["parts"]["gaps"]
    n = F.size(cells)

    def build(starts: Column) -> Column:
        def at(i: Column) -> Column:
            raw = cells[i][0]
            return F.struct(
                raw.alias("raw"), F.slice(cells[i], F.lit(2), F.size(cells[i])).alias("g"), starts[i].alias("start"), (starts[i] + F.length(raw)).alias("end")
            )

        return F.transform(F.sequence(F.lit(0), n - 1), at)

    # step i = gap before match i, plus match i-1
    steps = F.zip_with(
        F.slice(gaps, 1, n), F.concat(F.array(F.lit("")), F.transform(cells, lambda c: c[0])), lambda gap, before: F.length(gap) + F.length(before)
    )
    return F.coalesce(F.when(n > 0, bind(running_sums(F.slice(steps, 1, n)), build)), F.array().cast(_MATCHES))


def match_array(text: Column, pattern: str, groups: Sequence[int] = ()) -> Column:
    """``array<struct<raw, g, start, end>>`` of all matches of one pattern."""
    return bind(F.struct(*match_parts(text, pattern, groups)), located)


def running_sums(values: Column, block: int = 64) -> Column:
    """Prefix sums of an int array in close to linear time.

    Blocks are summed first, so an element adds up at most one block and the block totals
    before it instead of everything before it.
    """

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda s, v: s + v)

    def sums(v: Column) -> Column:
        n_blocks = F.ceil(F.size(v) / block).cast("int")

        def with_blocks(blocks: Column) -> Column:
            before = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: total(F.slice(blocks, 1, b)))

            def with_before(start: Column) -> Column:
                def at(i: Column) -> Column:
                    b = F.floor(i / block).cast("int")
                    return start[b] + total(F.slice(v, b * block + 1, i - b * block + 1))

                return F.transform(F.sequence(F.lit(0), F.size(v) - 1), at)

            return bind(before, with_before)

        return bind(F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: total(F.slice(v, b * block + 1, F.lit(block)))), with_blocks)

    return bind(values, sums)


def probe_text(text: Column) -> Column:
    """Case-folded text for literal tests, folding exactly what ``(?iu)`` treats as equal to ASCII."""
    return F.lower(F.translate(F.upper(text), _DOTTED_I, "I"))


_ANYTHING = "(?s:.{1,3})"  # one character, which as upper case may be three, or a line break
_CLASS = r"\[(?:\\.|[^\]\\])*\]"


def _paired(letter: str) -> bool:
    """Whether a Latin or Cyrillic letter has one upper and one lower case, whatever stands beside it."""
    known = 0xC0 <= ord(letter) < 0x180 or 0x400 <= ord(letter) < 0x460
    return known and letter not in "\u0131\u0130\u017f" and len(letter.upper()) == 1 and letter.upper().lower() == letter.lower() and len(letter.lower()) == 1


def relaxed(pattern: str) -> str | None:
    """An expression for linear-time engines that finds something in ``probe_text`` of every text that ``pattern`` matches.

    Surroundings are not asked for, and what is neither ASCII nor a letter of one plain
    case pair stands for anything; texts may have line breaks where the pattern sees
    spaces.  None for patterns whose syntax is not known to keep its meaning.
    """
    flags = re.match(r"\(\?[iuUd]+\)", pattern)
    body = re.sub(rf"\(\?<?[!=](?:{_CLASS}|[^()\[\]])*\)(?![?*+{{])", "", pattern[flags.end() if flags else 0 :])
    if re.search(r"\(\?(?!:)|\\[^\x00-\x7F]|\\(?![sdwb])[A-Za-z0-9]|\\$|[?*+}][+]", body):
        return None

    def part(m: re.Match) -> str:
        found = m.group()
        if found[0] == "[":
            if re.search(r"[\[&]|^\[\^", found[1:]) or found[1] in "^]":
                return _ANYTHING
            plain = re.fullmatch(r"\[-?(?:[a-z]-[a-z]|[0-9]-[0-9]|[!-,.-@^-~])*-?\]", found)
            return found if plain else _ANYTHING
        if found == r"\b":
            return ""
        if found == r"\d" and not (flags and "U" in flags.group()):
            return "[0-9]"
        if found in (" ", "\\ "):
            return r"(?:\r\n|[ \r\n])"
        if found in (".", r"\s", r"\d", r"\w") or ord(found[0]) > 127 and not _paired(found):
            return _ANYTHING
        return found.lower()

    out = re.sub(rf"(?s){_CLASS}|\\.|.", part, body)
    try:
        found = pc.match_substring_regex(pa.array([""]), out)[0].as_py()
    except pa.ArrowInvalid:
        return None
    return None if found else out


def possible_patterns(text: Column, gates: dict[int, str]) -> Column:
    """``array<int>``: the numbers of the relaxed patterns that find something in a text (Arrow batches)."""
    numbers = np.array(list(gates), "int32")

    @F.arrow_udf("array<int>")
    def possible(texts: pa.Array) -> pa.Array:
        tried = [pc.match_substring_regex(texts, g).fill_null(False).to_numpy(zero_copy_only=False) for g in gates.values()]
        at, which = np.nonzero(np.column_stack(tried))
        ends = np.searchsorted(at, np.arange(len(texts) + 1)).astype("int32")
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(numbers[which]))

    return possible(probe_text(text))


Pattern = tuple[str, str, str, Sequence[int]] | tuple[str, str, str, Sequence[int], Sequence[str]]


def regex_extract(df: DataFrame, patterns: Sequence[Pattern], keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """All matches of a pattern table in one pass over the texts: (keep, seq, name, raw, g, start, end).

    ``patterns``: (name, field, pattern, groups[, literals]).  Field ``full`` is the text,
    ``contiguous`` sees line breaks as spaces (same offsets for single-character breaks),
    ``clean`` is folded, lower-cased and has single spaces (offsets are its own).
    ``literals`` are lower-case ASCII strings of which every match contains one: a substring
    test that spares most texts the expression.
    """
    return scan_texts(df, patterns, {}, keep, text_col)


def scan_texts(df: DataFrame, patterns: Sequence[Pattern], dictionaries: dict[str, Iterable[str]], keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Matches of pattern tables and dictionaries in one reading of the texts.

    Rows as those of ``regex_extract``; a dictionary's have its name, and the pattern as
    only group.  ``dictionaries``: lower-cased patterns, whose size is the caller's to
    check; each keeps its own leftmost, longest, not overlapping matches.  Where there are
    many patterns, a linear-time look at each Arrow batch tells which of them a text may
    hold; only those run, over the whole text.
    """
    from larder.functions.text import clean, contiguous

    columns = {"full": F.col(text_col), "contiguous": F.col("__flat"), "clean": F.col("__clean")}
    base = df.select(*keep, text_col).where(F.col(text_col).isNotNull() & (F.col(text_col) != ""))
    fields = {p[1] for p in patterns}
    gates = {i: g for i, p in enumerate(patterns) if p[1] != "clean" and (g := relaxed(p[2])) is not None}
    if len(gates) > MOST_UNTOLD:
        base = base.withColumn("__possible", possible_patterns(F.col(text_col), gates))
    else:
        gates = {}
    if dictionaries:
        held = numbered({n: dict.fromkeys(t) for n, t in dictionaries.items()}, list(dictionaries))
        base = base.withColumn("__spans", term_spans(F.col(text_col), held, len(dictionaries)))
    tested = any(len(p) > 4 and p[4] for i, p in enumerate(patterns) if i not in gates)
    base = base.withColumn("__clash", F.contains(F.col(text_col), F.lit(_CUT)) | F.contains(F.col(text_col), F.lit(_FIELD)))
    if "contiguous" in fields or tested:
        base = base.withColumn("__flat", contiguous(F.col(text_col)))
    if "clean" in fields:
        base = base.withColumn("__clean", clean(F.col(text_col)))
    if tested:
        base = base.withColumn("__probe", probe_text(F.col("__flat")))
    no_spans = F.lit(None).cast(f"array<struct<name:string,{_MATCH}>>").alias("spans")

    def tagged(seq: int, name: str, field: str, pattern: str, groups: Sequence[int], literals: Sequence[str] = ()) -> Column:
        test = F.array_contains("__possible", seq) if seq in gates else columns[field].rlike(pattern)
        if literals and seq not in gates:
            possible = F.contains(F.col("__probe"), F.lit(literals[0]))
            for literal in literals[1:]:
                possible = possible | F.contains(F.col("__probe"), F.lit(literal))
            test = possible & test
        return F.when(test, F.struct(F.lit(seq).alias("seq"), F.lit(name).alias("name"), *match_parts(columns[field], pattern, groups, F.col("__clash")), no_spans))

    entries = [tagged(i, *entry) for i, entry in enumerate(patterns)]
    if dictionaries:
        names = F.array(*[F.lit(n) for n in dictionaries])
        spans = F.transform(
            F.col("__spans"),
            lambda m: F.struct(names[m["dictionary"]].alias("name"), m["matched"].alias("raw"), F.array(m["pattern"]).alias("g"), m["start"].alias("start"), m["end"].alias("end")),
        )
        none = F.lit(None).cast("struct<cells:array<array<string>>,gaps:array<string>>")
        entries.append(F.when(F.size("__spans") > 0, F.struct(F.lit(len(patterns)).alias("seq"), F.lit("").alias("name"), none.alias("parts"), spans.alias("spans"))))
    # null entries (pattern absent) vanish; offsets are built for the patterns that may have matched
    hits = base.select(*keep, F.explode(F.array_compact(F.array(*entries))).alias("p"))
    named = F.transform(located(F.col("p")), lambda m: F.struct(F.col("p.name").alias("name"), *[m[c].alias(c) for c in ("raw", "g", "start", "end")]))
    rows = hits.select(*keep, "p.seq", F.explode(F.when(F.col("p.spans").isNotNull(), F.col("p.spans")).otherwise(named)).alias("m"))
    return rows.select(*keep, "seq", "m.*")


def lowered(text: Column) -> Column:
    """Lower case of the same length: the dotted capital I becomes a marker."""
    return F.lower(F.translate(text, _DOTTED_I, _MARK))


def normalised_terms(terms: DataFrame) -> DataFrame:
    """One row per lower-cased pattern; of repeated patterns the last (``ord``) wins."""
    order = F.col("ord") if "ord" in terms.columns else F.struct("key", "name")
    rest = [c for c in terms.columns if c not in ("pattern", "ord")]
    return (
        terms.where(F.coalesce("pattern", F.lit("")) != "").groupBy(F.lower("pattern").alias("pattern"))
        .agg(F.max_by(F.struct(*rest), order).alias("t")).select("pattern", "t.*")
    )


class TermIndex:
    """Dictionaries of bounded size as one hash index of their patterns.

    A match begins at a word (or at a separator that begins some pattern) whose left
    neighbour is no word character.  ``lengths`` tells for a first word which pattern
    lengths to look up there, longest first; most words of a text begin no pattern and
    cost one look.
    """

    def __init__(self, patterns: dict[str, tuple[int, ...]]) -> None:
        self.patterns = patterns
        lengths: dict[str, set[int]] = {}
        for p in patterns:
            lengths.setdefault(first_word(p), set()).add(len(p))
        self.lengths = {w: sorted(n, reverse=True) for w, n in lengths.items()}
        self.starts = starts_of(self.lengths)

    def matches(self, low: str, dictionaries: int) -> list[tuple[int, int, int, str]]:
        """(dictionary, start, end, pattern): leftmost, longest, not overlapping in each dictionary."""
        out, free = [], [0] * dictionaries
        for m in self.starts.finditer(low):
            word = m.group()
            sizes = self.lengths.get(word if word[-1] != _MARK else word[:-1] + "i")
            if sizes is None:
                continue
            at, done = m.start(), set()
            for n in sizes:
                term, end = low[at : at + n], at + n
                if len(term) < n or low[end : end + 1] in _WORD_CHARS:
                    continue
                if term[-1] == _MARK:
                    term = term[:-1] + "i"
                for d in self.patterns.get(term, ()):
                    if d not in done and at >= free[d]:
                        out.append((d, at, end, term))
                        free[d] = end
                        done.add(d)
        return out


# a marker is the first half of a lower-cased dotted capital, an "i": no word ends before it
_WORD_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_" + _MARK)


def first_word(pattern: str) -> str:
    """The word a pattern begins with, or its first character."""
    return re.match(rf"{WORD}+|.", pattern, re.S).group()


def starts_of(words: Iterable[str]) -> re.Pattern:
    """Where a match may begin: at words, and at the separators among ``words``."""
    marks = "".join(sorted({re.escape(w) for w in words if not re.match(WORD, w)}))
    return re.compile(rf"(?<!{WORD})(?:{WORD}+{_MARK}?" + (f"|[{marks}])" if marks else ")"))


_SPAN = "array<struct<dictionary:int,start:int,end:int,pattern:string,matched:string>>"


def term_spans(text: Column, patterns: dict[str, tuple[int, ...]], dictionaries: int = 1) -> Column:
    """``array<struct<dictionary,start,end,pattern,matched>>`` of a text (Arrow batches).

    ``patterns``: which dictionaries hold a pattern; its size is the caller's to check.
    ``matched`` is the stretch of the text as it is.
    """
    kinds = [("dictionary", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.string()), ("matched", pa.string())]

    @F.arrow_udf(_SPAN)
    def spans(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        index = TermIndex(patterns)
        for lows, texts in batches:
            # a few texts at a time, so that what they hold together stays small
            for at in range(0, len(lows), PIECE_TEXTS):
                found, ends = [], [0]
                for low, shown in zip(lows.slice(at, PIECE_TEXTS), texts.slice(at, PIECE_TEXTS), strict=True):
                    hits = index.matches(low.as_py(), dictionaries) if low.is_valid else []
                    if hits:
                        whole = shown.as_py()
                        found += [(*m, whole[m[1] : m[2]]) for m in hits]
                    ends.append(len(found))
                columns = [pa.array([m[i] for m in found], kind) for i, (_, kind) in enumerate(kinds)]
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, [n for n, _ in kinds]))

    return spans(lowered(text), text)


def collected_terms(tables: Sequence[DataFrame], most_chars: int) -> list[dict[str, tuple[int, ...]] | None]:
    """Per table its patterns, or None from the table on whose characters pass ``most_chars`` together.

    Sizes are counted before anything is read.
    """
    out, left = [], most_chars
    for table in tables:
        size = table.agg(F.sum(F.length("pattern") + 8)).first()[0] or 0
        fits = size <= left
        left -= size if fits else 0
        out.append({r["pattern"]: None for r in table.select("pattern").toLocalIterator()} if fits else None)
    return out


def match_dictionaries(df: DataFrame, dictionaries: dict[str, DataFrame], keep: Sequence[str] = ("doc_id",), text_col: str = "text", most_chars: int = MOST_TERM_CHARS) -> dict[str, DataFrame]:
    """Matches of several dictionaries in one reading of the texts, by name; see ``dict_match``.

    Dictionaries of up to ``most_chars`` characters together become one index in the tasks;
    larger ones meet the texts in a join of their own, with the same matches.
    """
    tables = {n: normalised_terms(t) for n, t in dictionaries.items()}
    held = dict(zip(tables, collected_terms(list(tables.values()), most_chars), strict=True))
    small = [n for n, h in held.items() if h is not None]
    out = {}
    if small:
        rows = df.select(*keep, F.explode(term_spans(F.col(text_col), numbered(held, small), len(small))).alias("m"))
        for d, name in enumerate(small):
            mine = rows.where(F.col("m.dictionary") == d).select(*keep, "m.pattern", "m.start", "m.end", "m.matched")
            out[name] = mine.join(tables[name], "pattern")
    for name, h in held.items():
        if h is None:
            out[name] = dict_match_join(df, dictionaries[name], keep, text_col)
    return out


def numbered(held: dict[str, dict | None], names: Sequence[str]) -> dict[str, tuple[int, ...]]:
    """Which of the named dictionaries, by place, hold a pattern."""
    out: dict[str, tuple[int, ...]] = {}
    for d, name in enumerate(names):
        for p in held[name]:
            out[p] = (*out.get(p, ()), d)
    return out


def dict_match(df: DataFrame, terms: DataFrame, keep: Sequence[str] = ("doc_id",), text_col: str = "text",
               joined: bool = False, most_chars: int = MOST_TERM_CHARS) -> DataFrame:
    """Keyword dictionary matches: case-insensitive, leftmost, longest, non-overlapping.

    ``terms``: (key, name, pattern, ...), of any size: up to ``most_chars`` characters they
    are an index in the tasks, beyond that (or with ``joined``) texts and terms meet by
    first word.
    """
    if joined:
        return dict_match_join(df, terms, keep, text_col)
    return match_dictionaries(df, {"terms": terms}, keep, text_col, most_chars)["terms"]


_KINDS = {"int": (IntegerType(), pa.int32()), "string": (StringType(), pa.string())}


def text_rows(df: DataFrame, keep: Sequence[str], text_col: str, fields: dict[str, str], rows: Callable[[str, str], Iterable[tuple]]) -> DataFrame:
    """(keep, fields): the rows that ``rows`` makes of each text, lower-cased and as it is.

    Rows leave a task in batches of ``PIECE_ROWS``: its memory does not grow with the texts.
    """
    base = df.select(*keep, lowered(F.col(text_col)).alias("__low"), F.col(text_col).alias("__text")).where(F.col("__text") != "")
    schema = StructType([*base.drop("__low", "__text").schema.fields, *[StructField(n, _KINDS[k][0]) for n, k in fields.items()]])
    n_keep, kinds, names = len(keep), [_KINDS[k][1] for k in fields.values()], schema.fieldNames()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lows, texts = b.column("__low"), b.column("__text")

            def piece(made: list[tuple], b: pa.RecordBatch = b) -> pa.RecordBatch:
                at = pa.array([m[0] for m in made], pa.int32())
                columns = [pa.array([m[1][i] for m in made], kind) for i, kind in enumerate(kinds)]
                return pa.RecordBatch.from_arrays([*[b.column(i).take(at) for i in range(n_keep)], *columns], names)

            made: list[tuple] = []
            for i in range(b.num_rows):
                for row in rows(lows[i].as_py(), texts[i].as_py()):
                    made.append((i, row))
                    if len(made) == PIECE_ROWS:
                        yield piece(made)
                        made = []
            if made:
                yield piece(made)

    return base.mapInArrow(build, schema)


_ANY_START = rf"(?<!{WORD})(?:{WORD}+{_MARK}?|[^A-Za-z0-9_])"


def word_grams(df: DataFrame, keep: Sequence[str], text_col: str, widths: dict[str, int] | None, width: int, salts: dict[str, int] | int) -> DataFrame:
    """Possible match starts with the characters that follow, lower-cased and as they are: (keep, start, word, gram, shown, salt).

    ``widths``: for each first word how far its longest pattern reaches; other words give
    no row.  None: every word with the next ``width`` characters.  ``salts``: among how many
    parts the places of a word are dealt.
    """

    starts = re.compile(_ANY_START) if widths is None else starts_of(widths)

    def grams(low: str, text: str) -> Iterator[tuple]:
        own = crc32(low[:64].encode())
        for m in starts.finditer(low):
            word = m.group().replace(_MARK, "i")
            n = width if widths is None else widths.get(word, 0)
            if n:
                at = m.start()
                parts = salts if isinstance(salts, int) else salts.get(word, 1)
                yield at, word, low[at : at + n + 1], text[at : at + n], (own + at) % parts

    return text_rows(df, keep, text_col, {"start": "int", "word": "string", "gram": "string", "shown": "string", "salt": "int"}, grams)


def dict_match_join(df: DataFrame, terms: DataFrame, keep: Sequence[str] = ("doc_id",), text_col: str = "text", most_first_words: int = MOST_TOLD, hot: int = 1_000_000) -> DataFrame:
    """``dict_match`` for dictionaries of any size: equi-join on the first word.

    Up to ``most_first_words`` different first words are told to the readers of the texts,
    so that other words make no row.  Where the dictionary has more, the words of the texts
    are counted first, and only first words found there go on.  Hot words (articles, units)
    are spread by salting the text side and repeating the dictionary rows.  The join then
    verifies the whole pattern.
    """
    first = rf"(?s)^(?:{WORD}+|.)"
    lower = terms.where(F.coalesce("pattern", F.lit("")) != "").select(F.lower("pattern").alias("pattern"))
    firsts = lower.groupBy(F.regexp_extract("pattern", first, 0).alias("word")).agg(F.max(F.length("pattern")).alias("n"))
    n_first, width = firsts.agg(F.count(F.lit(1)), F.max("n")).first()
    salts: dict[str, int] | int = 16
    begun = terms
    if n_first > most_first_words:
        words = lambda low, _: Counter(m.group().replace(_MARK, "i") for m in re.finditer(_ANY_START, low)).items()
        seen = text_rows(df, (), text_col, {"word": "string", "times": "int"}, words).groupBy("word").agg(F.sum("times").alias("times"))
        firsts, n_first = cut_lineage(firsts.join(seen, "word"))
        width = firsts.agg(F.max("n")).first()[0]
        parts = firsts.select("word", F.ceil(F.col("times") / hot).cast("int").alias("parts")).where("parts > 1")
        salts = {r["word"]: r["parts"] for r in parts.toLocalIterator()}  # of words that are hot: at most words of the texts / hot
        begun = terms.withColumn("word", F.regexp_extract(F.lower("pattern"), first, 0)).join(firsts.select("word"), "word", "left_semi").drop("word")
    widths = {r["word"]: r["n"] for r in firsts.toLocalIterator()} if n_first <= most_first_words else None
    table = normalised_terms(begun).withColumn("word", F.regexp_extract("pattern", first, 0))
    salted = word_grams(df, keep, text_col, widths, width or 0, salts)
    if isinstance(salts, int):
        table = table.withColumn("parts", F.lit(salts))
    else:
        table = table.join(parts, "word", "left")
    repeated = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    n = F.length("pattern")
    inside = F.substring(F.col("gram"), n + 1, F.lit(1)).rlike(f"{WORD}|{_MARK}")
    # a final "i" may be the first half of a lower-cased dotted capital
    dotted = F.col("pattern").endswith("i") & F.col("gram").startswith(F.regexp_replace("pattern", "i$", _MARK))
    hits = salted.join(repeated, ["word", "salt"]).where((F.col("gram").startswith(F.col("pattern")) | dotted) & ~inside)
    hits = hits.withColumns({"end": F.col("start") + n, "matched": F.substring("shown", F.lit(1), n)}).drop("gram", "shown", "word", "salt")
    return leftmost_longest(hits, keep)


def leftmost_longest(hits: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Greedy non-overlapping choice per text: a fold over its sorted matches.

    The longest match per start is a partial aggregate; what is then collected is bounded
    by the words of one text.
    """
    rest = [c for c in hits.columns if c not in keep and c != "start"]
    longest = hits.groupBy(*keep, "start").agg(F.max_by(F.struct(*rest), "end").alias("m"))
    lists = longest.groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct("start", "m"))).alias("all"))
    empty = F.slice(F.col("all"), 1, 0)
    folded = F.aggregate(
        "all",
        F.struct(F.lit(-1).alias("last"), empty.alias("kept")),
        lambda acc, x: F.when(
            x["start"] >= acc["last"],
            F.struct(x["m"]["end"].alias("last"), F.concat(acc["kept"], F.array(x)).alias("kept")),
        ).otherwise(acc),
        lambda acc: acc["kept"],
    )
    return lists.select(*keep, F.explode(folded).alias("x")).select(*keep, "x.start", "x.m.*")


def _deletes(word: Column, budget: int) -> Column:
    """The word and all words made by deleting up to ``budget`` characters."""

    def shorter(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))),
            lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))),
        )

    out = F.array(word)
    layer = out
    for _ in range(budget):
        layer = F.array_distinct(F.flatten(F.transform(layer, shorter)))
        out = F.array_distinct(F.concat(out, layer))
    return out


def words_between(low: str, most: int, longest: int, told: Container[str] | None = None) -> Iterator[tuple]:
    """(idx, word, start, end, before, after): words of a lower-cased text and the separators on both sides.

    Separators longer than ``most`` are cut (no term reaches further); at the ends of the
    text they begin or end with a line end, so that they never equal a term's.  Words longer
    than ``longest``, or not among ``told``, are counted but left out.
    """
    found, idx = re.finditer(rf"{WORD}+{_MARK}?", low), 0
    here = next(found, None)
    before = "\n" + low[: here.start()] if here else ""
    while here:
        then = next(found, None)
        after = low[here.end() : then.start()] if then else low[here.end() :] + "\n"
        word = here.group().replace(_MARK, "i")
        if len(word) <= longest and (told is None or word in told):
            yield idx, word, here.start(), here.end(), before[-most:], after[:most]
        before, here, idx = after, then, idx + 1


def word_trie(patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, ends) of the trie of patterns, word by word; a node is named by its text.

    Edges: (parent, sep, term_word, node), the root being the empty text.  Ends: (node,
    pattern, lead, trail), with the separators before the first and after the last word.
    Patterns without a word are no part of it.
    """
    lead = F.regexp_extract("pattern", r"(?s)^[^A-Za-z0-9_]*", 0)
    trail = F.regexp_extract("pattern", r"(?s)[^A-Za-z0-9_]*$", 0)
    cut = patterns.where(F.col("pattern").rlike(WORD)).select("pattern", lead.alias("lead"), trail.alias("trail"))
    core = F.substring("pattern", F.length("lead") + 1, F.length("pattern") - F.length("lead") - F.length("trail"))
    parts = cut.select("pattern", "lead", "trail", core.alias("core"), F.regexp_extract_all(core, F.lit(rf"(?s){WORD}+|[^A-Za-z0-9_]+"), F.lit(0)).alias("parts"))
    at = F.explode(F.sequence(F.lit(0), F.size("parts") - 1, F.lit(2))).alias("at")
    upto = lambda n: F.array_join(F.slice("parts", F.lit(1), n), "")
    steps = parts.select("parts", at).select(
        F.when(F.col("at") > 0, upto(F.greatest(F.col("at") - 1, F.lit(0)))).otherwise("").alias("parent"), F.when(F.col("at") > 0, F.col("parts")[F.greatest(F.col("at") - 1, F.lit(0))]).otherwise("").alias("sep"),
        F.col("parts")[F.col("at")].alias("term_word"), upto(F.col("at") + 1).alias("node"),
    )
    return steps.distinct(), parts.select(F.col("core").alias("node"), "pattern", "lead", "trail")


def dict_match_fuzzy(df: DataFrame, terms: DataFrame, max_cost: int = 1, keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Dictionary matches within a Levenshtein budget: leftmost, longest, not overlapping.

    The budget is spent word by word along the dictionary's trie: distinct text words meet
    dictionary words over their deletion variants (two words within k edits share one), so
    no word is compared with every other; then all open beginnings of terms take one more
    word of their text per round, as long as budget is left.  Separators must be equal.
    Of matches with one start the longest counts, of equally long ones the cheapest, then
    the smaller pattern.
    """
    table = normalised_terms(terms)
    edges, ends = word_trie(table.select("pattern"))
    edges, _ = cut_lineage(edges)
    wanted = edges.select("term_word").distinct()
    longest, reach = edges.agg(F.max(F.length("term_word")), F.max(F.length("sep"))).first()
    outside = ends.agg(F.max(F.length("lead") + F.length("trail"))).first()[0]
    # a word longer than every term's by more than the budget is close to none: it would only be cut up
    most, longest = (reach or 0) + (outside or 0) + 1, (longest or 0) + max_cost
    distinct = lambda low, _: {(w[1],) for w in words_between(low, 1, longest)}
    vocab = text_rows(df, (), text_col, {"word": "string"}, distinct).distinct().select("word", F.explode(_deletes(F.col("word"), max_cost)).alias("v"))
    term_vocab = wanted.select("term_word", F.explode(_deletes(F.col("term_word"), max_cost)).alias("v"))
    close = (
        vocab.join(term_vocab, "v").select("word", "term_word").distinct()
        .withColumn("cost", F.levenshtein("word", "term_word")).where(F.col("cost") <= max_cost)
    )
    close, _ = cut_lineage(close)
    near = close.select("word").distinct()
    told = {r["word"] for r in near.toLocalIterator()} if near.count() <= MOST_TOLD else None
    fields = {"idx": "int", "word": "string", "start": "int", "end": "int", "before": "string", "after": "string"}
    words = text_rows(df, keep, text_col, fields, lambda low, _: words_between(low, most, longest, told))
    placed, _ = cut_lineage(words.join(close, "word").drop("word"))
    begun = placed.join(edges.where("parent = ''").select("term_word", "node"), "term_word")
    open_, n = cut_lineage(begun.select(*keep, "node", "idx", F.col("before").alias("first_gap"), "start", "end", "after", "cost"))
    reached = open_
    while n:
        further = open_.select(*keep, F.col("node").alias("parent"), (F.col("idx") + 1).alias("idx"), "first_gap", "start", F.col("cost").alias("spent"))
        step = placed.select(*keep, "idx", "end", F.col("before").alias("sep"), "after", "term_word", "cost").where(F.col("cost") <= max_cost)
        grown = further.join(step, [*keep, "idx"]).where(F.col("spent") + F.col("cost") <= max_cost).join(edges, ["parent", "sep", "term_word"])
        open_, n = cut_lineage(grown.select(*keep, "node", "idx", "first_gap", "start", "end", "after", (F.col("spent") + F.col("cost")).alias("cost")))
        reached = reached.unionByName(open_)
    bounded = lambda gap, sep, whole: (F.length(sep) == 0) | (whole & (F.length(gap) > F.length(sep)))
    hits = reached.join(ends, "node").where(
        bounded(F.col("first_gap"), F.col("lead"), F.col("first_gap").endswith(F.col("lead"))) & bounded(F.col("after"), F.col("trail"), F.col("after").startswith(F.col("trail")))
    )
    spans = hits.select(*keep, "pattern", (F.col("start") - F.length("lead")).alias("start"), (F.col("end") + F.length("trail")).alias("end"), "cost")
    cheapest = spans.groupBy(*keep, "start", "end").agg(F.min(F.struct("cost", "pattern")).alias("m")).select(*keep, "start", "end", "m.*")
    return leftmost_longest(cheapest, keep).join(table, "pattern")
