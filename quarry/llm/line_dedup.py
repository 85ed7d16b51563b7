"""Fuzzy line deduplication by SimHash blocks and edit similarity, DataFrame operations only.

Lines are normalised (lower case, runs of anything but letters, marks and digits collapsed to a space) and equal ones
counted as one class. At an edit similarity of 90 % a tenth of the bits of a SimHash over all words flip: blocks of
bits short enough to survive that are shared by far too many lines. So a line is cut into blocks by words instead of
bits. Its words' hashes are put in order, longer words, which tell lines apart, rather at the front; the SimHash of
three of them in a row, their bitwise majority, is a block. By the pigeonhole principle, e changed words spoil a few
of the blocks only, and lines that agree in a block meet; of lines of many words, two blocks in a row have to agree.
Lines of few words take runs of characters for words. Pairs that meet are verified by edit similarity; connected
groups keep their first occurrence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import connected_components, materialise, running_totals, scratch

BLOCKS = 12  # blocks of a kind that a line has at the most
GRAM = 6  # characters in a run
FEW, SOME = 5, 8  # distinct words up to which a line has blocks of runs alone, or of runs and of words
SHORT, LONG = 16, 24  # distinct words up to which single blocks are enough, and from which two in a row have to agree
OTHER = r"[^\p{L}\p{M}\p{N}\n]+"
COUNTED = ("abcdefgh", "ijklmnop", "qrstuvwx", "yz éóèñç")  # characters whose counts make a line's shape, eight to a long
SHAPE = [f"s{i}" for i in range(len(COUNTED))]


def normalised(text: Column) -> Column:
    """Lower case, with runs of anything but letters, marks, digits and line ends as one space."""
    return F.regexp_replace(F.lower(text), OTHER, " ")


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, th, line_no, norm) of every line; th is xxhash64 of the text, which tells repeated ids apart."""
    split = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.posexplode(F.split(normalised(F.col("text")), "\n")).alias("line_no", "norm"))
    return split.withColumn("norm", F.trim("norm"))


def _ordered(words: Column) -> Column:
    """Hashes of the distinct words; each two bytes of a word halve its hash."""
    return F.sort_array(F.array_distinct(F.transform(words, lambda w: F.call_function("shiftrightunsigned", F.xxhash64(w), F.shiftright(F.least(F.octet_length(w), F.lit(40)), 1)))))


def _simhashes(x: Column) -> Column:
    """The SimHash, which is the bitwise majority, of each three hashes in a row; of fewer than three, the first hash."""
    m = F.greatest(F.size(x) - 2, F.lit(0))
    pairs = F.zip_with(F.slice(x, 1, m), F.slice(x, 2, m), lambda a, b: F.struct(a.bitwiseAND(b).alias("both"), a.bitwiseOR(b).alias("some")))
    return F.when(m == 0, F.slice(x, 1, 1)).otherwise(F.zip_with(pairs, F.slice(x, 3, m), lambda ab, c: ab["both"].bitwiseOR(ab["some"].bitwiseAND(c))))


def with_blocks(lines: DataFrame) -> DataFrame:
    """Add ``blocks``, an array of longs, to lines with a column ``norm`` that isn't empty."""
    none = F.array().cast("array<long>")
    spread = lambda hashes: F.transform(F.slice(hashes, 1, BLOCKS + 4), lambda h: F.xxhash64(h))
    grams = F.when(F.length("norm") < GRAM, F.array("norm")).otherwise(F.regexp_extract_all("norm", F.lit(f"(?=(.{{{GRAM}}}))"), F.lit(1)))
    # Each step is a column of its own: inside of lambdas an expression would be computed for each element.
    out = lines.withColumn("_w", _ordered(F.split("norm", " ")))
    out = out.withColumns({"_n": F.size("_w"), "_x": spread(F.col("_w")), "_g": F.when(F.size("_w") <= SOME, spread(_ordered(grams))).otherwise(none)})
    out = out.withColumns({"_s": _simhashes(F.col("_x")), "_r": F.transform(F.slice(_simhashes(F.col("_g")), 1, BLOCKS), lambda x: F.xxhash64(x))})
    n, s = F.col("_n"), F.col("_s")
    m = F.least(F.lit(BLOCKS), F.greatest(F.size(s) - 2, F.lit(0)))
    two = F.zip_with(F.slice(s, 1, m), F.slice(s, 3, m), lambda a, b: F.xxhash64(a, b))
    some = F.concat("_r", F.when((n > FEW) & (n <= LONG), F.slice(s, 1, BLOCKS)).otherwise(none), F.when(n > SHORT, two).otherwise(none))
    return out.withColumn("blocks", F.array_distinct(some)).drop("_w", "_n", "_x", "_g", "_s", "_r")


def _sizes(a: str, b: str, percent: int) -> str:
    """Whether two lengths allow an edit similarity of ``percent``."""
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def alike(a: str, b: str, percent: int) -> Column:
    """Whether the edit distance of two columns is at most (100 - percent) % of the longer one's length."""
    most = f"greatest(length({a}), length({b}))"
    return F.expr(f"{_sizes(f'length({a})', f'length({b})', percent)} and levenshtein({a}, {b}, cast({100 - percent} * {most} div 100 as int)) >= 0")


def with_shape(texts: DataFrame) -> DataFrame:
    """Add longs ``SHAPE`` to rows with a column ``norm``: counts of 32 characters, eight bits each.

    The bits of counts c and c + 1 differ in one place, and come round after 16, so two counts differ in as many bits
    as they are apart, or in fewer. An edit changes two counts by one at the most.
    """
    codes = ", ".join(f"{(1 << c) - 1 if c <= 8 else 255 - ((1 << c - 8) - 1)}L" for c in range(16))
    count = lambda c: f"(octet_length(norm) - octet_length(replace(norm, '{c}', ''))) div {len(c.encode())} % 16"
    code = lambda c, i: f"shiftleft(get(array({codes}), cast({count(c)} as int)), {8 * i})"
    return texts.withColumns({s: F.expr(" | ".join(code(c, i) for i, c in enumerate(part))) for s, part in zip(SHAPE, COUNTED, strict=True)})


def _shapes(a: str, b: str, size_a: str, size_b: str, percent: int) -> str:
    """Whether two shapes, in columns of these endings, allow an edit similarity of ``percent``."""
    apart = " + ".join(f"bit_count({s}{a} ^ {s}{b})" for s in SHAPE)
    return f"{apart} <= 2 * cast({100 - percent} * greatest({size_a}, {size_b}) div 100 as int)"


def _once(rows: DataFrame, keep: list[str], columns: dict[str, str]) -> DataFrame:
    """``keep`` and the columns, each computed once for a row. By ``withColumns``, a later filter moves below them, and
    the optimiser puts their expressions into it as often as it names them."""
    return rows.select(*keep, F.inline(F.array(F.struct(*(F.expr(x).alias(c) for c, x in columns.items())))))


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose lines are alike.

    Cheaper steps come before the distance and change no result. Words of lines of equally many words are compared
    in pairs: the sum of their distances is no less than the distance of the lines. Words that two lines have in
    common at their ends are left out, but for the innermost, as the distance is that of the rest. And as the work
    grows with the bound, a sixteenth and a fourth of the bound are tried first.
    """
    x, y = (texts.select(F.col("cid").alias(c), F.col("norm").alias(f"n{c}")) for c in "ab")
    both = pairs.join(x, "a").join(y, "b").where(_sizes("length(na)", "length(nb)", percent))
    both = _once(both, ["a", "b"], {"most": f"cast({100 - percent} * greatest(length(na), length(nb)) div 100 as int)", "wa": "split(na, ' ')", "wb": "split(nb, ' ')"})
    in_turn = "if(size(wa) = size(wb) and size(wa) > 3, aggregate(zip_with(wa, wb, (x, y) -> if(x = y, 0, levenshtein(x, y))), 0, (s, d) -> s + d), null)"
    both = _once(both, ["a", "b", "most", "wa", "wb"], {"sure": f"coalesce({in_turn} <= most, false)"})
    same = lambda x, y: f"if(sure, 0, greatest(coalesce(cast(array_position(zip_with({x}, {y}, (x, y) -> x <=> y), false) as int), 1) - 2, 0))"
    both = _once(both, ["a", "b", "most", "wa", "wb", "sure"], {"p": same("wa", "wb"), "e": same("reverse(wa)", "reverse(wb)")})
    both = _once(both, ["a", "b", "most", "wa", "wb", "sure", "p"], {"q": "greatest(least(e, least(size(wa), size(wb)) - 1 - p), 0)"})
    rest = lambda x: f"if(sure, '', array_join(slice({x}, p + 1, size({x}) - p - q), ' '))"
    both = _once(both, ["a", "b", "most", "sure"], {"ra": rest("wa"), "rb": rest("wb")})
    return both.where(" or ".join(["sure", *(f"levenshtein(ra, rb, cast(most div {k} as int)) >= 0" for k in (16, 4, 1))])).select("a", "b")


def possible(rows: DataFrame, key: str, keys: DataFrame, bits: int = 24) -> DataFrame:
    """Rows whose key may be among the keys, by a bitmap of 2^bits bits of the keys' hashes, broadcast in pieces of 4 KB
    (2 MB at the most, whatever the number of keys). A fuller bitmap lets more rows through, never fewer."""
    slot = F.pmod(F.xxhash64(key), F.lit(1 << bits)) + 1
    maps = keys.groupBy(F.bitmap_bucket_number(slot).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("_bits"))
    four = lambda at: f"cast(conv(hex(substring(_bits, cast(8 * i + {at} as int), 4)), 16, 10) as bigint)"
    maps = maps.select("_bucket", F.expr(f"transform(sequence(0, 511), i -> shiftleft({four(1)}, 32) | {four(5)})").alias("_longs"))
    held = rows.withColumns({"_bucket": F.bitmap_bucket_number(slot), "_at": F.bitmap_bit_position(slot)}).join(F.broadcast(maps), "_bucket")
    return held.where("shiftright(get(_longs, cast(_at div 64 as int)), cast((7 - _at div 8 % 8) * 8 + _at % 8 as int)) & 1L != 0").drop("_bucket", "_at", "_longs")


def repeated_lines(docs: DataFrame, percent: int = 90, min_chars: int = 40) -> DataFrame:
    """(doc_id, th, line_no) of every line that repeats an earlier one, exactly or nearly.

    Lines of fewer than ``min_chars`` normalised characters are never counted as repeats. Lines are alike from an
    edit similarity of ``percent``. A group's first occurrence is the least (doc_id, th, line_no), null ids first;
    rows that repeat doc_id and text are one document. A null text has no lines.

    Equal lines collapse in the first grouping, by hashes: texts of lines aren't shuffled, but for those that meet
    another in a block. Pairs whose lengths or counts of characters rule a match out are left out where they are made;
    this changes no result. Every member of a block is compared with the block's first, which settles groups of near
    copies in linear work. What of a block isn't one group by then goes on: the next four members meet the rest, then
    sixteen, and so on, until every pair of the block has been compared or is connected.
    """
    with scratch() as keep:
        lines = lines_of(docs).withColumn("size", F.length("norm")).where(F.col("size") >= min_chars).withColumns({"h1": F.xxhash64("norm"), "h2": F.xxhash64(F.lit(7), "norm")})
        lines = materialise(with_blocks(lines).drop("norm"))
        where = F.struct("doc_id", "th", "line_no")
        grouped = lines.where("h1 is not null and h2 is not null").groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "th", "line_no", "size", "blocks")).alias("e"))
        classes = materialise(grouped.select(F.monotonically_increasing_id().alias("cid"), "h1", "h2", "e.*"))
        blocks = classes.select("cid", "size", F.explode("blocks").alias("v"))
        stars = materialise(blocks.groupBy("v").agg(F.min("cid").alias("leader"), F.max("cid").alias("z")).where("leader < z").select("v", "leader"), slim=True)
        met = materialise(possible(blocks, "v", stars.select("v")).join(stars, "v").select("v", "cid", "size", "leader"), slim=True)
        active = met.select("cid").distinct()
        first = materialise(possible(classes.select("cid", "doc_id", "th", "line_no"), "cid", active).join(active, "cid").withColumn("key", F.xxhash64("doc_id", "th", "line_no")), slim=True)
        raw = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("i"), F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n")).alias("no", "line")).withColumn("key", F.xxhash64("i", "t", "no"))
        raw = possible(raw, "key", first.select("key"))
        found = raw.join(first, "key").where(F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("th")) & (F.col("no") == F.col("line_no")))
        texts = materialise(with_shape(found.select("cid", F.trim(normalised(F.col("line"))).alias("norm")).dropDuplicates(["cid"])))
        # Of the pairs that meet, most are ruled out by sizes and shapes in the join: their texts aren't sent.
        met = materialise(met.join(texts.select("cid", *SHAPE), "cid"), slim=True)

        own = met.where("leader = cid").select("v", F.col("size").alias("most"), *(F.col(s).alias(f"{s}_a") for s in SHAPE))
        spokes = met.join(own, "v").where(f"leader <> cid and {_sizes('size', 'most', percent)} and {_shapes('', '_a', 'size', 'most', percent)}").select(F.col("leader").alias("a"), F.col("cid").alias("b")).distinct()
        tested = materialise(spokes, slim=True)
        links = materialise(_verified(tested, texts, percent))
        groups = materialise(connected_components(links), slim=True)
        rest, low, high = met.where("leader <> cid").drop("leader"), 0, 4
        while True:
            # What of a block isn't one group goes on; its members keep their places over the rounds.
            named = rest.join(groups.select(F.col("node").alias("cid"), "component"), "cid", "left").withColumn("own", F.coalesce("component", "cid")).drop("component")
            mixed = named.groupBy("v").agg(F.min("own").alias("_low"), F.max("own").alias("_high")).where("_low < _high").select("v")
            open_ = named.join(mixed, "v")
            open_ = materialise(open_ if low else running_totals(open_, [F.col("cid")], [], ["v"]).withColumnRenamed("pos", "place"), slim=True)
            if open_.isEmpty():
                break
            x = open_.where(f"place < {high}").select("v", F.col("cid").alias("a"), F.col("own").alias("own_a"), F.col("size").alias("size_a"), F.col("place").alias("at"), *(F.col(s).alias(f"{s}_a") for s in SHAPE))
            y = open_.select("v", F.col("cid").alias("b"), F.col("own").alias("own_b"), F.col("size").alias("size_b"), "place", *(F.col(s).alias(f"{s}_b") for s in SHAPE))
            pairs = x.join(y, "v").where(f"at < place and own_a <> own_b and {_sizes('size_a', 'size_b', percent)} and {_shapes('_a', '_b', 'size_a', 'size_b', percent)}").select("a", "b").distinct()
            pairs = materialise(pairs.join(tested, ["a", "b"], "left_anti"), slim=True)
            if not pairs.isEmpty():
                tested = tested.union(pairs)
                ends = pairs.select(F.explode(F.array("a", "b")).alias("cid"))
                links = materialise(_verified(pairs, possible(texts, "cid", ends), percent))
                if not links.isEmpty():  # what is connected stays so: each node's link to its component stands for its others
                    links = links.union(groups.select(F.col("node").alias("a"), F.col("component").alias("b")))
                    groups = materialise(connected_components(links), slim=True)
            rest, low, high = open_.where(f"place >= {high}").drop("own"), high, high + 4 * (high - low)

        # A group's first occurrence; other classes keep their own.
        slim = classes.select("cid", "h1", "h2", F.struct("doc_id", "th", "line_no").alias("first"))
        member = groups.withColumnRenamed("node", "cid").join(slim, "cid")
        merged = materialise(member.join(member.groupBy("component").agg(F.min("first").alias("whole")), "component").select("h1", "h2", "whole"), slim=True)
        firsts = slim.select("h1", "h2", "first").join(merged, ["h1", "h2"], "left").select("h1", "h2", F.coalesce("whole", "first").alias("first"))
        return keep(materialise(lines.select("doc_id", "th", "line_no", "h1", "h2").join(firsts, ["h1", "h2"]).where(where != F.col("first")).select("doc_id", "th", "line_no").distinct()))


def without_repeats(docs: DataFrame, percent: int = 90, min_chars: int = 40) -> DataFrame:
    """docs with struct column ``_lines``: (total, kept, text), text being the kept lines joined again.

    Documents without repeats, and null or empty texts, keep their text as it is.
    """
    gone = repeated_lines(docs, percent, min_chars).groupBy("doc_id", "th").agg(F.collect_list("line_no").alias("gone"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("t"), "text")
    both = rows.join(gone, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("th")), "left")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda _, i: ~F.array_contains("gone", i))
    total = F.coalesce(F.size(lines), F.lit(0)).cast("long")
    known = F.when(F.col("gone").isNull(), F.struct(total.alias("total"), total.alias("kept"), F.col("text").alias("text")))
    return both.select("row", known.otherwise(F.struct(total.alias("total"), (total - F.size("gone")).cast("long").alias("kept"), F.array_join(kept, "\n").alias("text"))).alias("_lines"))


def dedup_lines(docs: DataFrame, percent: int = 90, min_chars: int = 40) -> DataFrame:
    """docs without repeated lines. A document of which nothing but white space is left is dropped, unless it
    had no repeats to lose; n_chars follows the text."""
    out = without_repeats(docs, percent, min_chars)
    out = out.where((F.col("_lines.total") == F.col("_lines.kept")) | F.col("_lines.text").rlike(r"\S"))
    new = {"text": F.col("_lines.text"), "n_chars": F.when(F.col("_lines.total") == F.col("_lines.kept"), F.col("row.n_chars")).otherwise(F.length("_lines.text").cast("long"))} if "n_chars" in docs.columns else {"text": F.col("_lines.text")}
    return out.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
