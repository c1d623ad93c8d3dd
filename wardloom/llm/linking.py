"""Freely typed values mapped to a canonical list, in SQL only.

Reference strings are cut into k+1 segments. A typed string within k edits
holds at least one segment unchanged, at a place that shifts by few positions
(pigeonhole principle), so equality joins on positional substrings find every
candidate and ``levenshtein`` verifies them. Values are matched by the part of
a name that tells it from others: the list itself shows which words in front
and behind may be missing, its synonyms which words mean the same, and the
typed values which words are too frequent to be misspelt terms. What stays
unmatched comes out of an anti-join as concept 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.session import discard, interpreted, materialize

ACCENTS = ("áàâäãåéèêëíìîïóòôöõúùûüçñ", "aaaaaaeeeeiiiiooooouuuucn")
SUPPORT = 3  # different neighbours that show that words at an end of a name may be missing
RARER = 0.3  # a misspelt form stands at most so often, beside its term, ...
SELDOM = 3  # ... or in so many texts
STRENGTH = 0.5  # share of listed numbers from which the next word marks numbers that count
_TERM = "term string, kind string, ident string, cost double, k int"


def clean(text: Column) -> Column:
    """Lower case, no accents, zeros typed for the letter o put right, digits apart from letters, single blanks.

    A decimal point or comma becomes an underscore, a comma before three digits goes.
    """
    low = F.translate(F.lower(text), ACCENTS[0] + "_", ACCENTS[1] + " ")
    low = F.regexp_replace(low, r"(?<![0-9.,])0(?=[a-z])|(?<=[a-z])0(?![0-9])", "o")
    low = F.regexp_replace(low, r"(?<=[0-9]),(?=[0-9]{3}(?![0-9]))", "")
    low = F.regexp_replace(low, r"(?<=[0-9])[.,](?=[0-9])", "_")
    low = F.regexp_replace(low, r"(?<=[0-9])(?=[a-z])", " ")
    return F.trim(F.regexp_replace(low, "[^a-z0-9_]+", " "))


def _variants(spark: SparkSession, words: DataFrame) -> DataFrame:
    """Reference strings of ``words(word, kind, ident, abbreviable)``: the word, respelt, swapped, shortened.

    ``k``, the edits a typed string may be off, is 2 from six letters (1 for
    whole phrases), 1 from four, else 0. ``words`` counts the words of a term.
    """
    return spark.sql(
        """
        WITH base AS (
          SELECT DISTINCT replace(word, ' ', '') AS w, kind, ident, abbreviable, size(split(word, ' ')) AS words FROM {words} WHERE word <> ''
        ), spelt AS (
          SELECT * FROM base
          UNION
          SELECT replace(replace(w, 'oe', 'e'), 'ae', 'e'), kind, ident, abbreviable, words FROM base
        ), every AS (
          SELECT w AS term, kind, ident, 0D AS cost,
            CASE WHEN length(w) >= 6 AND kind <> 'pair' THEN 2 WHEN length(w) >= 4 THEN 1 ELSE 0 END AS k, words FROM spelt
          UNION ALL  -- neighbouring letters swapped
          SELECT concat(substr(w, 1, i - 1), substr(w, i + 1, 1), substr(w, i, 1), substr(w, i + 2)), kind, ident, 1D, 0, words
          FROM spelt LATERAL VIEW explode(sequence(1, greatest(length(w) - 1, 1))) AS i
          WHERE kind IN ('first', 'second')
          UNION ALL  -- cut short
          SELECT substr(w, 1, i), kind, ident, 0.6D, CASE WHEN i >= 6 THEN 1 ELSE 0 END, words
          FROM spelt LATERAL VIEW explode(sequence(abbreviable, length(w))) AS i
          WHERE abbreviable > 0 AND length(w) > abbreviable AND i < length(w)
          UNION ALL  -- vowels left out after the first letter
          SELECT concat(substr(w, 1, 1), regexp_replace(substr(w, 2), '[aeiou]', '')), kind, ident, 0.7D,
            CASE WHEN length(regexp_replace(substr(w, 2), '[aeiou]', '')) >= 5 THEN 1 ELSE 0 END, words
          FROM spelt WHERE abbreviable > 0 AND length(regexp_replace(substr(w, 2), '[aeiou]', '')) >= 2
        )
        SELECT term, kind, ident, min(cost) AS cost, max_by(k, -cost) AS k, max(words) AS words
        FROM every WHERE term <> '' GROUP BY term, kind, ident
        """,
        words=words,
    )


def cores(canonical: DataFrame, synonyms: DataFrame) -> DataFrame:
    """``(concept_id, w, first, second)``: the words of each name and the part that tells it from others.

    Words at the end of names may be missing where the words before them end
    other names or synonyms too, and words in front where the words behind
    them begin other names too, each seen with SUPPORT different neighbours;
    numbers count as one word here. What is left is cut before its number,
    else before its last word; a single word is all ``second``. ``w`` keeps
    the whole name.
    """
    spark = canonical.sparkSession
    names = canonical.where("concept_id is not null and trim(concept_name) <> ''").select(
        "concept_id", F.split(clean(F.col("concept_name")), " ").alias("w")
    )
    others = synonyms.where("trim(concept_synonym_name) <> ''").join(names.select("concept_id"), "concept_id", "left_semi")
    others = others.select(F.split(clean(F.regexp_replace("concept_synonym_name", ",(?![0-9]).*$", "")), " ").alias("w"))
    return spark.sql(
        """
        WITH ends AS (
          SELECT DISTINCT regexp_replace(element_at(w, -1), '^[0-9_]+$', '#') AS word
          FROM (SELECT w FROM {names} UNION ALL SELECT w FROM {others})
        ), starts AS (
          SELECT DISTINCT regexp_replace(w[0], '^[0-9_]+$', '#') AS word FROM {names}
        ), tails AS (
          SELECT s.tail FROM (
            SELECT array_join(slice(w, i, size(w)), ' ') AS tail, regexp_replace(w[i - 2], '^[0-9_]+$', '#') AS before, w[i - 2] AS raw
            FROM {names} LATERAL VIEW explode(sequence(2, greatest(size(w), 2))) AS i WHERE size(w) >= i
          ) s LEFT JOIN ends e ON s.before = e.word
          GROUP BY s.tail HAVING count(DISTINCT CASE WHEN e.word IS NOT NULL THEN s.raw END) >= """ + str(SUPPORT) + """ AND avg(if(e.word IS NULL, 0, 1)) > 0.5
        ), fronts AS (
          SELECT s.front FROM (
            SELECT array_join(slice(w, 1, i), ' ') AS front, regexp_replace(w[i], '^[0-9_]+$', '#') AS after, w[i] AS raw
            FROM {names} LATERAL VIEW explode(sequence(1, greatest(size(w) - 1, 1))) AS i WHERE size(w) > i
          ) s LEFT JOIN starts e ON s.after = e.word
          GROUP BY s.front HAVING count(DISTINCT CASE WHEN e.word IS NOT NULL THEN s.raw END) >= """ + str(SUPPORT) + """ AND avg(if(e.word IS NULL, 0, 1)) > 0.5
        ), cuts AS (
          SELECT n.concept_id, n.w, max(if(f.front IS NULL, 0, i)) AS skip, max(if(t.tail IS NULL, 0, size(n.w) - i)) AS drop
          FROM (SELECT *, array_join(slice(w, 1, i), ' ') AS a, array_join(slice(w, i + 1, size(w)), ' ') AS b
                FROM {names} LATERAL VIEW explode(sequence(0, size(w))) AS i) n
          LEFT JOIN fronts f ON n.a = f.front LEFT JOIN tails t ON n.b = t.tail
          GROUP BY n.concept_id, n.w
        ), kept AS (
          SELECT concept_id, w, if(skip + drop < size(w), slice(w, skip + 1, size(w) - skip - drop), w) AS c FROM cuts
        ), placed AS (
          SELECT *, coalesce(array_position(transform(c, x -> x rlike '^[0-9_]+$'), true), 0) AS at FROM kept
        ), cut AS (
          SELECT concept_id, w, c, CAST(if(at > 1, at, size(c)) AS int) AS at FROM placed
        )
        SELECT concept_id, w, array_join(slice(c, 1, at - 1), ' ') AS first, element_at(c, at) AS second FROM cut
        """,
        names=names,
        others=others,
    )


def reference_terms(canonical: DataFrame, synonyms: DataFrame, shortest: int = 4) -> tuple[DataFrame, DataFrame]:
    """:func:`_reference_terms` by interpreted plans: the list is small beside the typed values."""
    with interpreted(canonical.sparkSession):
        return _reference_terms(canonical, synonyms, shortest)


def _reference_terms(canonical: DataFrame, synonyms: DataFrame, shortest: int) -> tuple[DataFrame, DataFrame]:
    """Reference terms ``(term, kind, ident, cost, k, words)`` and keys ``(first, second, concept_id, w, shared)``.

    Kinds are 'first' and 'second' for the two parts of a key, 'pair' for whole
    keys and synonyms, and 'other' for words that tell no entries apart. What a
    synonym holds beside one part of its entry's key means the other part; so
    further words for both parts are learnt. Words cut short keep ``shortest``
    letters. Entries with the same key all stay, marked ``shared``; null ids
    and null or blank names are left out.
    """
    spark = canonical.sparkSession
    keys = materialize(cores(canonical, synonyms), "keys")
    syn = (
        synonyms.where("trim(concept_synonym_name) <> ''")
        .select("concept_id", clean(F.regexp_replace("concept_synonym_name", ",(?![0-9]).*$", "")).alias("name"))
        .join(keys, "concept_id")
        .select("concept_id", "first", "second", "name")
        .distinct()
    )
    # words that link the parts of many synonyms and stand in no key
    links = spark.sql(
        """
        SELECT word FROM (SELECT DISTINCT name, explode(split(name, ' ')) AS word FROM {syn}) s
        LEFT ANTI JOIN (SELECT explode(split(concat_ws(' ', first, second), ' ')) AS word FROM {keys}) k USING (word)
        WHERE NOT word rlike '^[0-9_]+$'
        GROUP BY word HAVING count(*) >= 0.1 * (SELECT count(*) FROM {syn})
        """,
        syn=syn,
        keys=keys,
    )
    syn = materialize(
        syn.crossJoin(links.agg(F.concat(F.lit("^("), F.concat_ws("|", F.lit("~"), F.collect_list("word")), F.lit(") ")).alias("link"))),  # one row
        "synonyms",
    )
    lay = spark.sql(
        """
        WITH first_1 AS (
          SELECT DISTINCT first AS ident, regexp_replace(substr(name, length(second) + 2), link, '') AS lay
          FROM {syn} WHERE startswith(name, concat(second, ' '))
          UNION SELECT first, substr(name, 1, length(name) - length(second) - 1) FROM {syn} WHERE endswith(name, concat(' ', second))
        ), second_1 AS (
          SELECT DISTINCT second AS ident, trim(substr(y.name, length(l.lay) + 2)) AS lay
          FROM {syn} y JOIN first_1 l ON y.first = l.ident AND startswith(y.name, concat(l.lay, ' '))
        ), lay_first AS (
          SELECT * FROM first_1
          UNION SELECT y.first, trim(substr(y.name, 1, length(y.name) - length(l.lay)))
          FROM {syn} y JOIN second_1 l ON y.second = l.ident AND endswith(y.name, concat(' ', l.lay))
        ), lay_second AS (
          SELECT * FROM second_1
          UNION SELECT y.second, trim(substr(y.name, length(l.lay) + 2))
          FROM {syn} y JOIN lay_first l ON y.first = l.ident AND startswith(y.name, concat(l.lay, ' '))
        )
        SELECT lay, 'first' AS kind, ident FROM lay_first WHERE ident <> '' AND lay <> ''
        UNION SELECT lay, 'second', ident FROM lay_second WHERE NOT ident rlike '^[0-9_]+$'
        """,
        syn=syn,
    )
    lay = materialize(lay, "lay")
    words = spark.sql(
        """
        WITH own AS (
          SELECT first AS word, 'first' AS kind, first AS ident, 1 AS short FROM {keys} WHERE first <> ''
          UNION SELECT second, 'second', second, 1 FROM {keys} WHERE NOT second rlike '^[0-9_]+$'
        ), every AS (
          SELECT * FROM own
          UNION SELECT lay, kind, ident, 1 FROM {lay}
          UNION SELECT concat_ws(' ', nullif(first, ''), second), 'pair', cast(concept_id AS string), 0 FROM {keys} WHERE NOT second rlike '^[0-9_]+$'
          UNION SELECT concat_ws(' ', second, first), 'pair', cast(concept_id AS string), 0 FROM {keys} WHERE first <> '' AND NOT second rlike '^[0-9_]+$'
          UNION SELECT array_join(filter(w, x -> NOT x rlike '^[0-9_]+$'), ' '), 'pair', cast(concept_id AS string), 0 FROM {keys} WHERE first = ''
          UNION SELECT name, 'pair', cast(concept_id AS string), 0 FROM {syn} WHERE NOT name rlike '[0-9]'
          UNION SELECT s.word, 'other', '', 0 FROM (SELECT explode(w) AS word FROM {keys}) s
            LEFT ANTI JOIN (SELECT explode(split(concat_ws(' ', first, second), ' ')) AS word FROM {keys}) k ON s.word = k.word
            WHERE NOT s.word rlike '^[0-9_]+$'
        )
        SELECT word, kind, ident, if(short = 1 AND NOT word rlike ' ', {shortest}, 0) AS abbreviable FROM every
        """,
        keys=keys,
        lay=lay,
        syn=syn,
        shortest=shortest,
    )
    pairs = spark.sql(
        "SELECT first, second, concept_id, w, count(*) OVER (PARTITION BY first, second) > 1 AS shared FROM {keys}", keys=keys
    )
    return materialize(_variants(spark, materialize(words, "words")), "terms"), materialize(pairs, "pairs")


def near_terms(grams: DataFrame, terms: DataFrame) -> DataFrame:
    """``(gram, term, kind, ident, cost, edits)``: every term within reach of each distinct ``gram``.

    ``terms`` carries its own k per string. Segment i of k+1 may shift between
    max(-i, d-(k-i)) and min(i, d+(k-i)) where d is the difference in length.
    """
    spark = grams.sparkSession
    cut = spark.sql(
        """
        SELECT t.*, length(term) AS tlen, i,
          cast(floor(i * length(term) / (k + 1)) AS int) AS pos,
          cast(floor((i + 1) * length(term) / (k + 1)) - floor(i * length(term) / (k + 1)) AS int) AS seglen
        FROM {terms} t LATERAL VIEW explode(sequence(0, k)) AS i
        """,
        terms=terms,
    )
    segments = materialize(cut.withColumn("seg", F.expr("substr(term, pos + 1, seglen)")), "segments")
    return spark.sql(
        """
        WITH shapes AS (
          SELECT DISTINCT tlen, k, i, pos, seglen, n FROM {segments}
          LATERAL VIEW explode(sequence(tlen - k, tlen + k)) AS n
        ), probes AS (
          SELECT g.gram, s.tlen, s.k, s.i, substr(g.gram, s.pos + 1 + shift, s.seglen) AS seg
          FROM (SELECT gram, length(gram) AS n FROM {grams}) g JOIN shapes s ON g.n = s.n
          LATERAL VIEW explode(sequence(greatest(-i, s.n - tlen - (k - i)), least(i, s.n - tlen + (k - i)))) AS shift
          WHERE s.pos + shift >= 0 AND s.pos + shift + s.seglen <= s.n
            AND greatest(-i, s.n - tlen - (k - i)) <= least(i, s.n - tlen + (k - i))
        )
        SELECT DISTINCT p.gram, t.term, t.kind, t.ident, t.cost + levenshtein(p.gram, t.term, t.k) AS cost,
          levenshtein(p.gram, t.term, t.k) AS edits
        FROM probes p JOIN {segments} t ON p.seg = t.seg AND p.tlen = t.tlen AND p.k = t.k AND p.i = t.i
        WHERE levenshtein(p.gram, t.term, t.k) >= 0
        """,
        segments=segments,
        grams=grams,
    )


def cheapest(near: DataFrame) -> DataFrame:
    """``(gram, kind, ident, cost)``: the cheapest terms of each gram; where words of no key fit best, none."""
    return near.sparkSession.sql(
        """
        WITH best AS (
          SELECT gram, min(cost) AS least, collect_set(struct(kind, ident, cost)) AS found FROM {near} GROUP BY gram
        )
        SELECT gram, f.kind, f.ident, min(f.cost) AS cost
        FROM best LATERAL VIEW explode(filter(found, x -> x.cost <= least + 0.05D)) AS f
        WHERE f.kind <> 'other' GROUP BY gram, f.kind, f.ident
        """,
        near=near,
    )


def match_strings(grams: DataFrame, terms: DataFrame) -> DataFrame:
    """``(gram, kind, ident, cost)``: the cheapest terms within reach of each distinct ``gram``."""
    return cheapest(near_terms(grams, terms))


def link(values: DataFrame, text: str, terms: DataFrame, pairs: DataFrame) -> DataFrame:
    """``values`` with ``concept_id``: the entry each non-blank ``text`` means, or 0.

    A word as frequent as a term's own forms (RARER, SELDOM) is no misspelling
    of it. Where the second part of a key is a number, numbers in front of
    words that mostly follow listed numbers count first, then any number. Rows
    with null or blank text are left out, repeated rows stay; a column
    ``concept_id`` of ``values`` is replaced. Of several entries the one with
    the fewest edits wins, then, of those with the same key, the one whose
    other words the text holds, then the smallest id.
    """
    spark = values.sparkSession
    values = values.drop("concept_id").where(F.trim(F.col(text)) != "").withColumn("_clean", clean(F.col(text)))
    texts = materialize(
        values.select("_clean").distinct().select(
            "_clean", F.monotonically_increasing_id().alias("tid"), F.split("_clean", " ").alias("w")
        ),
        "texts",
    )
    reach = terms.agg(
        F.min(F.length("term") - F.col("k")).alias("shortest"),
        F.max(F.length("term") + F.col("k")).alias("longest"),
        F.greatest(F.max("words"), F.lit(3)).alias("most"),
        F.array_distinct(F.flatten(F.collect_set(F.when(F.col("words") > 3, F.sequence(F.length("term") - F.col("k"), F.length("term") + F.col("k")))))).alias("long"),
    )
    # grams that no term can reach by length are left out; each text's own are distinct
    grams = spark.sql(
        """
        SELECT tid, explode(array_distinct(transform(
          filter(
            flatten(transform(sequence(1, size(w)), i -> transform(sequence(1, least(most, size(w) - i + 1)),
              n -> struct(n AS n, array_join(slice(w, i, n), '') AS gram)))),
            g -> length(g.gram) BETWEEN greatest(shortest, 1) AND longest AND (g.n <= 3 OR array_contains(long, length(g.gram)))),
          g -> g.gram))) AS gram
        FROM (SELECT tid, filter(w, x -> NOT x rlike '^[0-9_]+$') AS w FROM {texts}) CROSS JOIN {reach} r WHERE size(w) > 0
        """,
        texts=texts,
        reach=reach,
    )
    grams = materialize(grams, "grams")
    often = materialize(grams.groupBy("gram").agg(F.count("*").alias("n")), "often")
    near = materialize(near_terms(often, terms), "near")
    near = spark.sql(
        """
        SELECT r.gram, r.kind, r.ident, r.cost FROM {near} r JOIN {often} o ON r.gram = o.gram
        LEFT JOIN {often} t ON r.term = t.gram
        WHERE r.edits = 0 OR r.kind = 'other' OR o.n <= greatest(""" + str(SELDOM) + """, """ + str(RARER) + """ * coalesce(t.n, 0))
        """,
        near=near,
        often=often,
    )
    matched = materialize(cheapest(near), "matched")
    found = spark.sql(
        """
        SELECT tid, collect_list(struct(kind, ident, cost)) AS hits FROM (
          SELECT tid, kind, ident, min(cost) AS cost FROM {grams} g JOIN {matched} m ON g.gram = m.gram GROUP BY tid, kind, ident
        ) GROUP BY tid
        """,
        grams=grams,
        matched=matched,
    )
    found = materialize(found.join(texts.select("tid", "w"), "tid"), "found")
    numbered = spark.sql("SELECT first, second FROM {pairs} WHERE second rlike '^[0-9_]+$' GROUP BY first, second", pairs=pairs)
    numbers = spark.sql(
        """
        SELECT tid, w[i] AS number, CASE WHEN i + 1 >= size(w) THEN '' WHEN w[i + 1] rlike '^[0-9_]+$' THEN '#' ELSE w[i + 1] END AS next,
          transform(filter(hits, h -> h.kind = 'first'), h -> h.ident) AS firsts
        FROM {found} LATERAL VIEW explode(sequence(0, size(w) - 1)) AS i WHERE w[i] rlike '^[0-9_]+$'
        """,
        found=found,
    )
    numbers = materialize(numbers, "numbers")
    marks = spark.sql(
        """
        SELECT next FROM (
          SELECT n.tid, n.number, n.next, max(if(p.second IS NULL, 0, 1)) AS listed
          FROM (SELECT *, explode(firsts) AS first FROM {numbers}) n LEFT JOIN {numbered} p ON n.first = p.first AND n.number = p.second
          GROUP BY n.tid, n.number, n.next
        ) GROUP BY next HAVING avg(listed) >= """ + str(STRENGTH) + """
        """,
        numbers=numbers,
        numbered=numbered,
    )
    marks = materialize(marks, "marks")
    counting = spark.sql(
        """
        SELECT tid, transform(if(size(strong) > 0, strong, bare), x -> struct('second' AS kind, x AS ident, 0D AS cost)) AS counts FROM (
          SELECT n.tid, collect_set(if(m.next IS NULL, NULL, n.number)) AS strong, collect_set(n.number) AS bare
          FROM {numbers} n LEFT JOIN {marks} m ON n.next = m.next GROUP BY n.tid
        )
        """,
        numbers=numbers,
        marks=marks,
    )
    linked = spark.sql(
        """
        WITH sided AS (
          SELECT f.tid, f.w, f.hits, filter(hits, h -> h.kind = 'first') AS firsts,
            filter(hits, h -> h.kind = 'second') AS seconds, c.counts
          FROM {found} f LEFT JOIN {counting} c ON f.tid = c.tid
        ), near AS (  -- far-fetched readings of other words don't compete with a close one
          SELECT tid, w, filter(firsts, f -> f.cost <= array_min(transform(firsts, x -> x.cost)) + 0.75D) AS firsts,
            concat(filter(seconds, f -> f.cost <= array_min(transform(seconds, x -> x.cost)) + 0.75D), coalesce(counts, array())) AS seconds
          FROM sided
        ), both AS (
          SELECT tid, w, f.ident AS first, s.ident AS second, f.cost + s.cost AS cost FROM near
          LATERAL VIEW explode(firsts) AS f
          LATERAL VIEW explode(seconds) AS s
        ), scored AS (
          SELECT tid, p.concept_id, cost, if(shared, size(array_except(p.w, b.w)), 0) AS apart
          FROM both b JOIN {pairs} p ON b.first = p.first AND b.second = p.second
          UNION ALL
          SELECT tid, cast(h.ident AS bigint), h.cost, size(array_except(p.w, s.w)) FROM (
            SELECT tid, w, explode(filter(hits, h -> h.kind = 'pair')) AS h FROM sided
          ) s JOIN {pairs} p ON cast(s.h.ident AS bigint) = p.concept_id
        )
        SELECT tid, min(struct(cost, apart, concept_id)).concept_id AS concept_id FROM scored GROUP BY tid
        """,
        found=found,
        counting=counting,
        pairs=pairs,
    )
    linked = materialize(linked, "linked")
    answered = spark.sql(
        """
        SELECT t._clean, l.concept_id FROM {texts} t JOIN {linked} l ON t.tid = l.tid
        UNION ALL
        SELECT t._clean, 0 FROM {texts} t LEFT ANTI JOIN {linked} l ON t.tid = l.tid
        """,
        texts=texts,
        linked=linked,
    )
    discard(grams, often, found, numbers)
    return values.join(answered, "_clean").drop("_clean")
