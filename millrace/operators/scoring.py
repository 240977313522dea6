"""Property scoring: normalised features, rules, per-sample scores and the corpus report."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.scoring import BANDS, CORE_FEATURES, FEATURE_WEIGHTS, LESS_IS_BETTER, MORE_IS_BETTER, feature_reward, number_of, set_f_score
from millrace.functions.text import bound, flat_key, plain_key, split_key, stripped
from millrace.functions.records import PLAIN_ALIAS
from millrace.functions.trie import longest_matches, within
from millrace.functions.vocabulary import MERGES, PHRASES, alias_entries, default_aliases
from millrace.operators.stats import upper_median
from millrace.session import ship

FEATURE_SCHEMA = "feature string, direction int, lo double, hi double, threshold double, weight double, is_core boolean"


def feature_table(spark: SparkSession, thresholds: dict[str, float] | None = None, extra_less: tuple[str, ...] = ()) -> DataFrame:
    """The dimension of known features: direction (1 more, -1 less, 0 band), band, threshold, weight, core."""
    thresholds = thresholds or {}
    names = dict.fromkeys([*CORE_FEATURES, *FEATURE_WEIGHTS, *BANDS, *MORE_IS_BETTER, *LESS_IS_BETTER, *extra_less, *thresholds])
    rows = []
    for f in names:
        low = f.lower()
        d = 0 if f in BANDS else 1 if f in MORE_IS_BETTER else -1 if f in LESS_IS_BETTER or f in extra_less or low.endswith("inhibitor") and f != "Pgp inhibitor" or low.startswith("toxicity:") else None
        lo, hi = BANDS.get(f, (None, None))
        rows.append((f, d, lo, hi, thresholds.get(f), FEATURE_WEIGHTS.get(f, 1.0), f in CORE_FEATURES))
    return spark.createDataFrame(rows, FEATURE_SCHEMA)


def resolve_aliases(entries: DataFrame) -> DataFrame:
    """alias (lower case, unique), canonical and pos of a table of entries: canonical, alias, pos and, if it has one, block.

    Each canonical name is an alias of itself, and its place is its first entry's. Entries of a later block replace those
    of the same name in earlier ones, and keep that place. Of names that list one alias the last by place has it; pos is
    the place of the first that lists it.
    """
    block = F.col("block") if "block" in entries.columns else F.lit(0)
    rows = entries.select("canonical", F.lower(stripped("alias")).alias("alias"), "pos", block.alias("block"))
    names = rows.groupBy("canonical").agg(F.min("pos").alias("place"), F.max("block").alias("last"))
    kept = rows.join(names, "canonical").where(F.col("block") == F.col("last")).select("alias", "canonical", "place")
    own = names.select(F.lower(stripped("canonical")).alias("alias"), "canonical", "place")
    return kept.union(own).groupBy("alias").agg(F.max_by("canonical", "place").alias("canonical"), F.min("place").alias("pos"))


def alias_table(spark: SparkSession, more: dict[str, str] | None = None) -> DataFrame:
    """alias, canonical and pos of the default aliases, and of further ones, which come last."""
    entries = [(c, a) for c, a in alias_entries() if a not in (more or {})] + [(c, a) for a, c in (more or {}).items()]
    first: dict[str, int] = {}
    for k, (_, alias) in enumerate(entries):
        first.setdefault(alias, k)
    return spark.createDataFrame([(a, c, first[a]) for a, c in {a: c for c, a in entries}.items()], "alias string, canonical string, pos long")


def phrase_table(spark: SparkSession, more: dict[str, str] | None = None) -> DataFrame:
    """phrase, feature, direction and pos of the known phrases, features by their canonical names."""
    aliases = default_aliases() | (more or {})
    flat = {re.sub("[^0-9a-z]+", "", a): c for a, c in aliases.items()}

    def canonical(name: str) -> str:
        known = aliases.get(name.lower(), name)
        known = MERGES.get(known, known)
        return flat.get(re.sub("[^0-9a-z]+", "", known.lower()), known)

    named = {phrase: (canonical(feature), direction) for phrase, feature, direction in PHRASES}
    return spark.createDataFrame([(p, f, d, k) for k, (p, (f, d)) in enumerate(named.items())], "phrase string, feature string, direction string, pos int")


def canonical_names(names: DataFrame, aliases: DataFrame | None = None, *, merges: dict[str, str] = MERGES, name: str = "name") -> DataFrame:
    """name and feature of distinct names.

    aliases: alias (lower case, unique), canonical and, for the last step, pos; by default alias_table. A name is looked
    up as it is, with seams split, with _ and - as spaces; the first that is known wins, else the spaced name stays; then
    merges are applied, and the letters and digits alone looked up: of aliases that have them in common the last by pos
    wins, of IG C50 and IGC50 the latter; none at all is unknown.
    """
    aliases = alias_table(names.sparkSession) if aliases is None else aliases
    merged = F.create_map(*(F.lit(x) for kv in merges.items() for x in kv)) if merges else F.create_map().cast("map<string,string>")
    pos = F.col("pos") if "pos" in aliases.columns else F.lit(0)
    flat = aliases.select(flat_key("alias").alias("alias"), "canonical", pos.alias("pos")).where("alias <> ''").groupBy("alias").agg(F.max_by("canonical", F.struct("pos", "canonical")).alias("canonical"))
    seams = split_key(name)
    spaced = stripped(F.regexp_replace(F.regexp_replace(seams, r"[_\-]+", " "), r"\s+", " "))
    forms = [plain_key(name), F.lower(stripped(seams)), F.lower(spaced)]
    out = names.select(name).distinct()
    for k, form in enumerate(forms):
        out = out.withColumn(f"_f{k}", form).join(aliases.select(F.col("alias").alias(f"_f{k}"), F.col("canonical").alias(f"_c{k}")), f"_f{k}", "left")
    out = out.withColumn("_found", F.coalesce("_c0", "_c1", "_c2", spaced))
    out = out.withColumn("_known", F.coalesce(F.try_element_at(merged, F.col("_found")), "_found")).withColumn("_flat", flat_key("_known"))
    out = out.join(flat.select(F.col("alias").alias("_flat"), F.col("canonical").alias("_c3")), "_flat", "left")
    return out.select(name, F.coalesce("_c3", "_known").alias("feature"))


def normalized_features(props: DataFrame, aliases: DataFrame | None = None, *, merges: dict[str, str] = MERGES, sample: str = "sample_id", role: str = "role", name: str = "name", raw: str = "raw", pos: str = "pos") -> DataFrame:
    """Long features with canonical names (canonical_names, worked out once for each distinct name) and numbers.

    Of names that become one, the last by pos wins; a null name stays null.
    """
    known = canonical_names(props, aliases, merges=merges, name=name).withColumnRenamed(name, "_name")
    numbers = props.join(known, F.col(name).eqNullSafe(F.col("_name"))).select(sample, role, "feature", number_of(raw).alias("value"), pos)
    return numbers.groupBy(sample, role, "feature").agg(F.max_by("value", pos).alias("value")).where("value IS NOT NULL")


#: Aliases of one pattern; more take further passes over the texts.
PATTERN = 4096


def alias_hits(texts: DataFrame, aliases: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, alias, canonical, start (from 0) and end of every alias in lower-cased whole texts, also inside of one another.

    Names of letters, digits, spaces, - and _ are found wherever they stand as whole words, others where they stand first
    in a text. The aliases (alias, lower case and unique, and canonical; by default alias_table) become patterns of
    PATTERN each, and each pattern is one pass. A null text counts as empty; repeated rows repeat; a blank alias is
    nowhere, and one that can overlap itself is refused.
    """
    aliases = alias_table(texts.sparkSession) if aliases is None else aliases
    known = {r["alias"]: r["canonical"] for r in aliases.select("alias", "canonical").collect() if r["alias"] and r["alias"].strip()}  # a dictionary of names
    plain = sorted(a for a in known if re.fullmatch(PLAIN_ALIAS, a))
    if refused := [a for a in plain if _overlaps_as_words(a)]:
        raise ValueError(f"can overlap themselves: {refused}")
    other = sorted(known.keys() - set(plain))
    low = texts.select(F.col(id_col).alias("_id"), F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_low"))
    spark, parts = texts.sparkSession, []
    for words, whole in ((plain, True), (other, False)):
        for at in range(0, len(words), PATTERN):
            own = words[at : at + PATTERN]
            inner = [(w, a, known[a]) for w, found in within(own, whole).items() for a in found]
            spread = F.broadcast(spark.createDataFrame(inner, "word string, alias string, canonical string"))
            found = longest_matches(F.col("_low"), own, whole)
            hits = low.select("_id", F.explode(found if whole else _firsts(found, within(own, whole))).alias("m")).select("_id", "m.start", "m.word")
            hits = hits.join(spread, "word") if whole else hits.join(spread.where("word = alias"), "word")
            parts.append(hits.select(F.col("_id").alias(id_col), "alias", "canonical", "start", (F.col("start") + F.length("alias")).alias("end")))
    return reduce(DataFrame.union, parts)


def _overlaps_as_words(alias: str) -> bool:
    """Whether an alias of several words ends in whole words that it begins with."""
    words = re.split("[ -]", alias)
    return any(words[-k:] == words[:k] for k in range(1, len(words)))


def _firsts(matches: Column, inner: dict[str, list[str]]) -> Column:
    """start and word of the first place of each word, those inside of longer ones among them."""
    table = F.create_map(*(x for w, own in inner.items() for x in (F.lit(w), F.array(*map(F.lit, own)))))
    all_ = F.flatten(F.transform(matches, lambda m: F.transform(F.try_element_at(table, m["word"]), lambda a: F.struct(m["start"].alias("start"), a.alias("word")))))
    first = lambda m, k, own: ~F.exists(F.slice(own, 1, k), lambda x: x["word"] == m["word"])
    return bound(all_, lambda own: F.filter(own, lambda m, k: first(m, k, own)))


def lookup(molecules: DataFrame, client: Callable[[str], dict], *, tries: int = 3, smiles: str = "smiles") -> DataFrame:
    """smiles and props (a map) by an injected client; each distinct molecule is asked once, with retries; failures give an empty map."""

    ship(molecules.sparkSession)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for batch in batches:
            found = []
            for s in batch[smiles]:
                props: dict = {}
                for k in range(tries):
                    try:
                        props = {str(a): str(b) for a, b in (client(s) or {}).items()}
                        break
                    except ImportError:
                        raise
                    except Exception:  # noqa: BLE001  the client's own errors
                        time.sleep(min(0.2 * 2**k, 1.6))
                found.append(props)
            yield pd.DataFrame({smiles: batch[smiles], "props": found})

    clean = F.regexp_replace(smiles, r"(?i)\s*<end>\s*$", "").alias(smiles)
    return molecules.select(clean).distinct().mapInPandas(ask, f"{smiles} string, props map<string,string>")


def bad_features(features: DataFrame, rules: DataFrame) -> DataFrame:
    """Features that break a rule. rules: feature, flag (one of > < >= <= between), threshold, upper."""
    v, t = F.col("value"), F.col("threshold")
    broken = F.when(F.col("flag") == ">", v > t).when(F.col("flag") == "<", v < t).when(F.col("flag") == ">=", v >= t).when(F.col("flag") == "<=", v <= t).when(F.col("flag") == "between", ~v.between(t, F.col("upper")))
    return features.join(rules, "feature").where(F.coalesce(broken, F.lit(False))).select("sample_id", "role", "feature").distinct()


def sample_scores(features: DataFrame, bad: DataFrame, dims: DataFrame, *, w_main: float = 0.8, w_bonus: float = 1.0, predicted: DataFrame | None = None, corrected: bool = False) -> DataFrame:
    """One row for each sample: base, coverage, efficiency, total score, F-score and counts.

    Two shuffles: features and bad marks meet in one aggregation by (sample, feature), then one by sample.
    predicted: sample_id, reasoned, features (array).
    """
    marks = features.select("sample_id", "feature", "role", "value", F.lit(False).alias("bad")).unionByName(bad.select("sample_id", "feature", "role", F.lit(None).cast("double").alias("value"), F.lit(True).alias("bad")))
    of = lambda role, what: F.max(F.when(F.col("role") == role, F.col(what)))
    wide = marks.groupBy("sample_id", "feature").agg(of("orig", "value").alias("o"), of("opt", "value").alias("p"), F.coalesce(of("orig", "bad"), F.lit(False)).alias("ob"), F.coalesce(of("opt", "bad"), F.lit(False)).alias("pb"))
    d = wide.join(dims, "feature", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0))).withColumn("is_core", F.coalesce("is_core", F.lit(False)))
    both = F.col("o").isNotNull() & F.col("p").isNotNull()
    reward = feature_reward(F.col("o"), F.col("p"), F.col("direction"), F.col("lo"), F.col("hi"), F.col("threshold"), F.col("weight"), corrected)
    scorable = F.col("direction").isNotNull()
    any_opt = F.max(F.when(F.col("p").isNotNull(), True)).over(_by_sample())
    rows = d.withColumn("reward", reward).withColumn("any_opt", F.coalesce(any_opt, F.lit(False)))
    fixed = F.when(F.col("ob") & F.col("p").isNotNull() & F.col("o").isNotNull() & scorable, F.col("reward")).when(F.col("ob") & F.col("p").isNull(), F.when(F.col("any_opt"), 0.5).otherwise(0.1)).when(~F.col("ob") & both & scorable, 0.5 * F.col("reward"))
    new_bad = F.col("pb") & ~F.col("ob")
    listed = F.coalesce(fixed.isNotNull().cast("int"), F.lit(0)) + new_bad.cast("int")
    gain = F.when(both & scorable, F.col("reward"))
    per = rows.groupBy("sample_id").agg(
        F.sum(F.coalesce(fixed, F.lit(0.0)) + F.when(new_bad, -0.3).otherwise(0.0)).alias("main"),
        F.sum(listed * F.col("weight")).alias("weights"), F.sum(listed).alias("n_listed"),
        F.sum(F.when(F.col("is_core"), listed).otherwise(0)).alias("n_core"),
        F.sum((gain > 0).cast("int")).alias("improved"), F.sum((gain < 0).cast("int")).alias("degraded"),
        F.collect_set(F.when(F.col("ob"), F.col("feature"))).alias("bad"),
    )
    base = F.coalesce(F.try_divide(F.col("main"), 2 * F.col("weights")), F.lit(0.0))
    coverage = 0.1 * F.least(F.col("n_core") / F.lit(16), F.lit(1.0))
    rate = F.coalesce(F.try_divide(F.col("improved"), F.col("improved") + F.col("degraded")), F.lit(0.0))
    per = per.withColumn("base", base).withColumn("coverage", coverage).withColumn("efficiency", F.when(rate > 0.5, 0.2 * (rate - 0.5)).otherwise(0.0))
    norm = F.when(F.col("base") >= 0, F.least(F.col("base") + F.col("coverage") + F.col("efficiency"), F.lit(1.0))).otherwise(F.greatest(F.col("base"), F.lit(-1.0)))
    if predicted is None:
        per = per.withColumn("f_score", F.lit(0.0))
    else:
        joined = per.join(predicted.select("sample_id", F.col("features").alias("_p"), "reasoned"), "sample_id", "left")
        per = joined.withColumn("f_score", set_f_score("bad", F.coalesce("_p", F.array().cast("array<string>")), F.coalesce("reasoned", F.lit(False)))).drop("_p", "reasoned")
    return per.withColumn("norm_main", norm).withColumn("total", w_main * F.col("norm_main") + w_bonus * F.col("f_score"))


def _by_sample():
    from pyspark.sql import Window

    return Window.partitionBy("sample_id")


#: Phrases of one automaton: tens of MB on each worker.
AUTOMATON = 100_000


def _automaton_hits(texts: DataFrame, phrases: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = [tuple(r) for r in phrases.collect()]  # at most AUTOMATON
    shared = texts.sparkSession.sparkContext.broadcast(rows)
    kind = texts.schema[id_col].dataType.simpleString()

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton, everywhere = ahocorasick.Automaton(), []
        for k, (phrase, *_) in enumerate(shared.value):
            if phrase:
                automaton.add_word(phrase, [*automaton.get(phrase, []), k])
            else:
                everywhere.append(k)
        automaton.make_automaton()
        for batch in batches:
            found = []
            for i, text in zip(batch[id_col], batch["_low"], strict=True):
                hits = {k for _, ks in automaton.iter(text) for k in ks} if len(automaton) else set()
                found += [(i, *shared.value[k]) for k in [*everywhere, *hits]]
            yield pd.DataFrame(found, columns=[id_col, "phrase", "feature", "direction", "pos"])

    ship(texts.sparkSession)
    return texts.select(id_col, F.lower(F.coalesce(text_col, F.lit(""))).alias("_low")).mapInPandas(find, f"{id_col} {kind}, phrase string, feature string, direction string, pos int")


def phrase_features(texts: DataFrame, phrases: DataFrame | None = None, *, id_col: str = "sample_id", text_col: str = "text", inline: int = 64) -> DataFrame:
    """id, feature, direction of phrases found in lower-cased texts; of a feature's phrases the first by pos.

    phrases: phrase, feature, direction, pos (by default phrase_table). Up to `inline` phrases are folded into one
    expression; more go through automata of AUTOMATON phrases each, a pass over the texts for every one. A null text
    counts as empty, and an empty phrase is in every text.
    """
    phrases = phrase_table(texts.sparkSession) if phrases is None else phrases
    if (n := phrases.count()) <= inline:
        rows = phrases.orderBy("pos").collect()
        table = F.array(*(F.struct(F.lit(r["phrase"]).alias("phrase"), F.lit(r["feature"]).alias("feature"), F.lit(r["direction"]).alias("direction"), F.lit(int(r["pos"])).alias("pos")) for r in rows))
        low = F.lower(F.coalesce(text_col, F.lit("")))
        hits = texts.select(id_col, F.explode(F.filter(table, lambda p: F.contains(low, p["phrase"]))).alias("h")).select(id_col, "h.*")
    else:
        blocks = -(-n // AUTOMATON)
        own = phrases.select("phrase", "feature", "direction", F.col("pos").cast("int").alias("pos"))
        split = [own.where(F.pmod(F.xxhash64("phrase", "pos"), F.lit(2 * blocks)) == k) for k in range(2 * blocks)] if blocks > 1 else [own]
        hits = reduce(DataFrame.union, (_automaton_hits(texts, part, id_col, text_col) for part in split))
    return hits.groupBy(id_col, "feature").agg(F.min_by("direction", "pos").alias("direction"))


def corpus_report(scores: DataFrame, *, value: str = "total", group: list[str] | None = None, used: str | None = None, marked: str | None = None, core: str | None = None) -> DataFrame:
    """Count, means, bounds, the upper median and population deviation of the scores, of each group or of all.

    used: a column that is null in rows that were skipped: how many were used and skipped; marked: a column that is null
    in rows without a reasoning: the share of rows with one; core: how many core features were looked at, as sample_scores
    counts them (n_core): the mean of its share in all of them.
    """
    group, n = group or [], F.count("*")
    more = [F.count(used).alias("used"), (n - F.count(used)).alias("skipped")] if used else []
    more += [F.avg(F.col(marked).isNotNull().cast("double")).alias("share")] if marked else []
    more += [F.round(F.avg(F.col(core) / len(CORE_FEATURES)), 4).alias("core_coverage")] if core else []
    bounds = scores.groupBy(*group).agg(n.alias("count"), F.round(F.avg(value), 4).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.stddev_pop(value).alias("std"), *more)
    middle = upper_median(scores, value, group).withColumnRenamed("upper_median", "median")
    both = bounds.join(middle, group, "left") if group else bounds.join(F.broadcast(middle), how="left")  # one row each
    return both.select(*group, "count", "mean", "min", "max", "median", "std", *(c for c in ("used", "skipped", "share", "core_coverage") if c in both.columns))


def top_features(listed: DataFrame, k: int = 10, *, feature: str = "feature", order: str = "pos") -> DataFrame:
    """The k most frequent features; ties by first seen."""
    return listed.groupBy(feature).agg(F.count("*").alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first", feature).limit(k)
