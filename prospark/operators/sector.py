"""Search of a catalogue of sectors by words, through an index of its words, codes and synonyms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import fold


def _variants(w: Column) -> Column:
    """A word with and without its plural s."""
    cut = F.when((F.length(w) > 4) & w.endswith("s"), F.substring(w, F.lit(1), F.length(w) - 1)).when((F.length(w) > 3) & ~w.endswith("s"), F.concat(w, F.lit("s")))
    return F.array_compact(F.array(w, cut))


def _stem(w: Column) -> Column:
    return F.when(F.length(w) >= 5, F.concat(F.lit("="), F.substring(w, 1, 5)))


def _beginnings(w: Column, least: int = 1) -> Column:
    return F.when(F.length(w) >= least, F.transform(F.sequence(F.lit(least), F.length(w)), lambda n: F.substring(w, F.lit(1), n))).otherwise(F.array().cast("array<string>"))


def _grams(x: Column) -> Column:
    return F.when(F.length(x) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - 2), lambda i: F.substring(x, i, 3)))).otherwise(F.array().cast("array<string>"))


def word_index(catalogue: DataFrame) -> DataFrame:
    """(key, word): what a query word may be to match a word of the catalogue's labels: a beginning of it or its stem."""
    words = catalogue.select(F.explode(F.split(fold(F.col("label")), " ")).alias("word")).where("word != ''").distinct()
    forms = F.flatten(F.transform(F.filter(_variants(F.col("word")), lambda v: F.length(v) >= 2), _beginnings))
    keys = F.array_distinct(F.concat(forms, F.array_compact(F.array(_stem(F.col("word"))))))
    return words.select(F.explode(keys).alias("key"), "word")


def search(queries: DataFrame, catalogue: DataFrame, synonyms: DataFrame, best: int = 12) -> DataFrame:
    """The `best` items of catalogue(place, code, label) for each of queries(query_id, query): query_id, code, score, position.

    The first rule that fires gives the score: 100 the code, 95 a code that begins so, 90 a synonym, 75 a synonym that holds
    the query (three letters or more), 80 all words match words of the label, 70 the label holds the query, else 40 and 10 for
    each matching word of three letters or more.  A word matches what begins with it or its other number, and what shares its
    first five letters.  synonyms has (synonym, code).  Equal scores keep the catalogue's order, in which each place is there
    once; queries below two signs find nothing.  Items of one code share the words of their labels.

    Every rule is an equi-join on codes, beginnings, words or runs of three letters.  Equal queries are one text and items
    with equal words and label one class: texts meet classes, and of a class only the first items that can be among the best.
    What is told apart into many rows is never broadcast: nothing bounds it, and its size is underestimated.
    """
    raw = queries.where(F.length(F.trim("query")) >= 2).select("query_id", fold(F.col("query")).alias("q")).where("q != ''").distinct()
    texts = raw.select("q").distinct()
    bare = lambda c: F.regexp_replace(c, "[^a-z0-9]", "")
    items = catalogue.select("place", "code", F.lower("code").alias("low"), fold(F.col("label")).alias("label"))
    bags = items.groupBy("code").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("label", " "))))).alias("words"))
    items = items.join(bags.hint("merge"), "code")
    codes = catalogue.select("code", F.lower("code").alias("low")).distinct()

    def rule(found: DataFrame, order: int, score: int) -> DataFrame:
        return found.select("q", "code", F.struct(F.lit(order).alias("order"), F.lit(score).alias("score")).alias("rule"))

    def holding(held: DataFrame, text: str) -> DataFrame:
        """Texts of three letters or more that stand in another one: met by their first three, then looked for."""
        runs = held.select("*", F.explode(_grams(F.col(text))).alias("gram"))
        return texts.where(F.length("q") >= 3).withColumn("gram", F.substring("q", 1, 3)).join(runs.hint("merge"), "gram").where(F.contains(text, "q")).drop("gram")

    # codes and synonyms point at codes
    exact = texts.withColumn("bare", bare(F.col("q"))).join(codes.withColumn("bare", bare(F.col("low"))).hint("merge"), "bare").unionByName(texts.withColumn("bare", F.col("q")).join(codes.withColumn("bare", F.col("low")).hint("merge"), "bare"))
    begins = texts.join(codes.select("code", F.explode(_beginnings(F.col("low"))).alias("q")).hint("merge"), "q")
    known = synonyms.select(fold(F.col("synonym")).alias("synonym"), "code").distinct()
    same = texts.join(known.hint("merge"), F.col("q") == F.col("synonym"))
    rules = [rule(exact, 0, 100), rule(begins, 1, 95), rule(same, 2, 90), rule(holding(known, "synonym"), 3, 75)]
    pointed = reduce(DataFrame.unionByName, rules).groupBy("q", "code").agg(F.min("rule")["score"].alias("score"))
    pointed = pointed.join(items.select("place", "code", "words", "label").hint("merge"), "code")

    # words and labels meet classes of items
    one = ["words", "label"]
    classes = items.groupBy(one).agg(F.min("place").alias("first"))
    words = texts.select("q", F.explode(F.array_distinct(F.filter(F.split("q", " "), lambda w: F.length(w) >= 2))).alias("w"))
    asked = words.select("q", "w", F.explode(F.array_distinct(F.concat(_variants(F.col("w")), F.array_compact(F.array(_stem(F.col("w"))))))).alias("key"))
    met = asked.join(word_index(catalogue).hint("merge"), "key").select("q", "w", "word").distinct()
    inside = classes.select("words").distinct().select("words", F.explode("words").alias("word"))
    hits = met.join(inside.hint("merge"), "word").groupBy("q", "words").agg(F.count_distinct("w").alias("n"), F.count_distinct(F.when(F.length("w") >= 3, F.col("w"))).alias("long"))
    hits = hits.join(words.groupBy("q").agg(F.count("*").alias("all")).hint("merge"), "q")
    by_words = hits.select("q", "words", F.when(F.col("n") == F.col("all"), F.struct(F.lit(4).alias("order"), F.lit(80).alias("score"))).when(F.col("long") > 0, F.struct(F.lit(6).alias("order"), (40 + 10 * F.col("long")).cast("int").alias("score"))).alias("rule"))
    by_words = by_words.where("rule is not null").join(classes.hint("merge"), "words")
    by_label = holding(classes, "label").withColumn("rule", F.struct(F.lit(5).alias("order"), F.lit(70).alias("score")))
    pairs = by_words.unionByName(by_label).groupBy("q", *one).agg(F.min("rule")["score"].alias("score"), F.min("first").alias("first"))

    # a class among the best has less than `best` ones ahead whose first item counts for it; so have its items
    taken = pointed.join(classes.hint("merge"), one).groupBy("q", *one).agg(F.count("*").alias("taken"), F.max((F.col("place") == F.col("first")).cast("int")).alias("hidden"))
    pairs = pairs.join(taken.hint("merge"), ["q", *one], "left").fillna(0, ["taken", "hidden"])
    ahead = Window.partitionBy("q").orderBy(F.desc("score"), "first").rowsBetween(Window.unboundedPreceding, -1)
    pairs = pairs.withColumn("ahead", F.coalesce(F.sum(1 - F.col("hidden")).over(ahead), F.lit(0))).where(F.col("ahead") < best)
    numbered = items.withColumn("number", F.row_number().over(Window.partitionBy(one).orderBy("place"))).select("place", "code", *one, "number")
    told = pairs.select("q", *one, "score", "taken").join(numbered.hint("merge"), one).where(F.col("number") <= best + F.col("taken"))
    told = told.join(pointed.select("q", "place").hint("merge"), ["q", "place"], "left_anti")

    top = Window.partitionBy("q").orderBy(F.desc("score"), "place")
    found = pointed.select("q", "code", "score", "place").unionByName(told.select("q", "code", "score", "place"))
    ranked = found.withColumn("position", F.row_number().over(top)).where(F.col("position") <= best)
    return raw.join(ranked.hint("merge"), "q").select("query_id", "code", "score", "position")


def fallback(queries: DataFrame, catalogue: DataFrame, found: DataFrame, best: int = 8) -> DataFrame:
    """For queries that found nothing: the first `best` labels that hold them, at 50."""
    left = queries.join(found.select("query_id").distinct(), "query_id", "left_anti").select("query_id", fold(F.col("query")).alias("q")).where("length(q) >= 3")
    runs = catalogue.select("code", "place", fold(F.col("label")).alias("label"))
    runs = runs.select("code", "place", "label", F.explode(_grams(F.col("label"))).alias("gram"))
    hits = left.withColumn("gram", F.substring("q", 1, 3)).join(runs, "gram").where(F.contains("label", "q")).dropDuplicates(["query_id", "code"])
    ranked = hits.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("place")))
    return ranked.where(F.col("position") <= best).select("query_id", "code", F.lit(50).alias("score"), "position")
