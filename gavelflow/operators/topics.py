"""Topics near harm: spans of patterns, their distances, and what they mean; word-list lookups."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelflow.functions.text import curation_key, let

# How many characters a harm may be from a topic.
LIMITS = {"threat": 16, "degradation": 24, "profanity": 32, "sexual": 48, "hate_action": 64, "sexual_abuse": 96}
DIRECT, DEFAULT_LIMIT = 8, 96
GROUPS = ("race", "gender")


@dataclass(frozen=True)
class TopicRules:
    """Patterns of topics, of harms (keys as in LIMITS), of what shows a group is meant, and of contexts that
    speak against harm. The caller brings them; none come with the library."""

    topics: dict[str, list[str]]
    harms: dict[str, list[str]]
    group_context: list[str] = field(default_factory=list)
    counter: list[str] = field(default_factory=list)


#: What a harm near a topic adds: labels and severity, those of group topics after those of others. A harm counts
#: within its limit; what it needs besides is in _counts.
EFFECTS = {
    "threat": ((("THREAT", "TOXIC"), 5), (("THREAT", "TOXIC"), 5)),
    "group_threat": (None, (("HATE",), 5)),
    "sexual": ((("NSFW",), 4), (("NSFW",), 4)),
    "sexual_abuse": ((("NSFW", "TOXIC"), 5), (("NSFW", "TOXIC"), 5)),
    "degradation": ((("TOXIC",), 3), (("TOXIC", "HATE"), 4)),
    "hate_action": ((("TOXIC",), 3), (("TOXIC", "HATE"), 4)),
    "profanity": ((("PROFANITY",), 1), (("PROFANITY",), 1)),
}
_SPANS = "array<struct<s:int,e:int>>"


def spans(text: Column, patterns: list[str]) -> Column:
    """array<struct<s, e>> of all matches of the patterns. A match begins where the pieces and matches before it
    end, so splitting and extracting give the offsets that no built-in function returns."""

    def of(pattern: str) -> Column:
        p = "(?U)" + pattern

        def placed(parts: Column) -> Column:
            sizes = F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda m, i: F.struct(F.length(F.get(parts, i)).alias("gap"), F.length(m).alias("n")))
            start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("found"))

            def step(acc: Column, x: Column) -> Column:
                begin = acc["at"] + x["gap"]
                return F.struct((begin + x["n"]).alias("at"), F.concat(acc["found"], F.array(F.struct(begin.alias("s"), (begin + x["n"]).alias("e")))).alias("found"))

            return F.aggregate(sizes, start, step, lambda acc: acc["found"])

        return F.when(text.rlike(p), let(F.split(text, p, -1), placed)).otherwise(F.array().cast(_SPANS))

    return F.concat(F.array().cast(_SPANS), *[of(p) for p in patterns])


def near(a: Column, b: Column, limit: int) -> Column:
    """Whether a span of one array is within so many characters of one of the other; 0 where they touch."""
    return F.exists(a, lambda x: F.exists(b, lambda y: F.greatest(x["s"] - y["e"], y["s"] - x["e"], F.lit(0)) <= limit))


def _counts(topic: Column, harm: dict[str, Column], context: Column, grouped: bool) -> dict[str, Column]:
    """When each effect holds for a topic's spans."""
    within = lambda h, limit=None: near(topic, harm[h], LIMITS.get(h, DEFAULT_LIMIT) if limit is None else limit) if h in harm else F.lit(False)
    meant = near(topic, context, LIMITS["hate_action"])  # a group is meant
    out = {h: within(h) for h in ("threat", "sexual", "sexual_abuse", "profanity")}
    out["group_threat"] = out["threat"] & (within("threat", DIRECT) | meant)
    out["degradation"] = within("degradation") & (meant | within("degradation", DIRECT)) if grouped else within("degradation")
    out["hate_action"] = within("hate_action") if grouped else within("hate_action") & within("hate_action", DIRECT)
    return out


def annotate(df: DataFrame, rules: TopicRules, text: str = "text") -> DataFrame:
    """Adds topics, added, minimum and requires_review: the topics of a text, the labels and the least severity that
    harms near them give, and whether someone should look. A text that a counter pattern matches adds nothing, and
    needs a look if there is a harm in it at all; other texts do if a topic brings no label."""
    x = df.withColumn("_k", curation_key(F.coalesce(F.col(text), F.lit(""))))
    x = x.withColumns({f"_t_{t}": spans(F.col("_k"), ps) for t, ps in rules.topics.items()})
    some = F.lit(False)
    for t in rules.topics:
        some = some | (F.size(f"_t_{t}") > 0)
    # the other patterns are looked for only where there is a topic
    on_topic = F.when(some, F.col("_k")).otherwise("")
    x = x.withColumn("_on", on_topic)
    any_of = lambda ps: F.greatest(F.lit(False), F.lit(False), *[F.col("_on").rlike("(?U)" + p) for p in ps])
    x = x.withColumns({**{f"_h_{h}": spans(F.col("_on"), ps) for h, ps in rules.harms.items()}, "_c": spans(F.col("_on"), rules.group_context), "_no": any_of(rules.counter)})
    harm = {h: F.col(f"_h_{h}") for h in rules.harms}
    labels, severity = [], [F.lit(0), F.lit(0)]
    for t in rules.topics:
        grouped = t in GROUPS
        for effect, when in _counts(F.col(f"_t_{t}"), harm, F.col("_c"), grouped).items():
            if (gives := EFFECTS[effect][grouped]) is not None:
                labels.append(F.when(when, F.array(*map(F.lit, gives[0]))))
                severity.append(F.when(when, gives[1]).otherwise(0))
    none = F.array().cast("array<string>")
    x = x.withColumn("topics", F.array_compact(F.array(*[F.when(F.size(f"_t_{t}") > 0, F.lit(t)) for t in sorted(rules.topics)])))
    x = x.withColumn("_l", F.array_sort(F.array_distinct(F.flatten(F.array_compact(F.array(none, *labels))))))
    harmed = F.lit(False)
    for h in harm.values():
        harmed = harmed | (F.size(h) > 0)
    x = x.withColumns({
        "added": F.when(F.col("_no"), none).otherwise(F.col("_l")),
        "minimum": F.when(F.col("_no"), 0).otherwise(F.greatest(*severity)),
        "requires_review": (F.size("topics") > 0) & F.when(F.col("_no"), harmed).otherwise(F.size("_l") == 0),
    })
    return x.select(*df.columns, "topics", "added", "minimum", "requires_review")


def topic_flags(text: Column, topics: dict[str, list[str]]) -> Column:
    """Names of the topics with a pattern in the text, in the JVM."""
    hit = lambda ps: F.greatest(*[text.rlike("(?U)" + p) for p in ps], F.lit(False))
    return F.array_compact(F.array(*[F.when(hit(ps), F.lit(k)) for k, ps in topics.items()]))


# Beginnings and parts of words that are obscene whatever the vocabulary says.
STEMS = ("бляд", "еба", "еби", "ебу", "ёба", "пизд", "пидор", "пидр", "хуе", "хуй", "суч", "долбоеб")


def with_aliases(vocabulary: DataFrame) -> DataFrame:
    """(word, category) with two more spellings of words that end in a soft sign, where the vocabulary doesn't
    have them itself."""
    words = vocabulary.select(F.lower("word").alias("word"), "category")
    soft = words.where(F.col("word").endswith("ь"))
    body = F.expr("substring(word, 1, length(word) - 1)")
    more = soft.select(F.explode(F.array(F.concat(body, F.lit("д")), F.concat(body, F.lit("т")))).alias("word"), "category")
    more = more.groupBy("word").agg(F.min("category").alias("category")).join(words, "word", "left_anti")
    return words.unionByName(more)


def listed_words(df: DataFrame, key: str, text: str, vocabulary: DataFrame, least: int = 3, stems: tuple[str, ...] = STEMS, stem_category: str = "obscene") -> DataFrame:
    """(key, word, category): for each word of a text, and each word that it spells out letter by letter, the
    category of the longest of its beginnings, of least characters or more, that the vocabulary (word, category)
    has; else stem_category if one of the stems is in it. A join by equality of beginnings."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)[\w-]+"), F.lit(0))
    w = df.select(key, F.explode(F.array_distinct(F.concat(found, spelled_out(F.col(text))))).alias("word"))
    heads = w.where(F.length("word") >= least).select(key, "word", F.explode(F.sequence(F.lit(least), F.length("word"))).alias("n"))
    heads = heads.withColumn("head", F.expr("substring(word, 1, n)"))
    hit = heads.join(with_aliases(vocabulary).withColumnRenamed("word", "head"), "head").select(key, "word", "n", "category")
    if stems:
        stemmed = w.where(F.col("word").rlike("|".join(stems))).select(key, "word", F.lit(0).alias("n"), F.lit(stem_category).alias("category"))
        hit = hit.unionByName(stemmed)
    return hit.groupBy(key, "word").agg(F.max(F.struct("n", "category")).alias("b")).select(key, "word", "b.category")


def spelled_out(text: Column) -> Column:
    """Words that are spelt letter by letter with separators, squeezed: 3 to 32 letters."""
    run = r"(?iU)(?<![а-яё])(?:[а-яё][\s.\-·•*_|]+){2,}[а-яё](?![а-яё])"
    found = F.regexp_extract_all(F.lower(text), F.lit(run), F.lit(0))
    squeezed = F.transform(found, lambda x: F.regexp_replace(x, "(?iu)[^а-яё]+", ""))
    return F.array_distinct(F.filter(squeezed, lambda x: (F.length(x) >= 3) & (F.length(x) <= 32)))


def profanity_flags(df: DataFrame, key: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """Adds profanity_obscene, profanity_literary and separator_obfuscation to messages, for the rules. Only
    hits are joined back."""
    hit = listed_words(df, key, text, vocabulary)
    has = lambda c: F.coalesce(F.bool_or(F.col("category") == c), F.lit(False))
    by = hit.groupBy(key).agg(has("obscene").alias("profanity_obscene"), has("literary").alias("profanity_literary"), F.collect_set("word").alias("_words"))
    x = df.join(by, key, "left")
    out = {c: F.coalesce(c, F.lit(False)) for c in ("profanity_obscene", "profanity_literary")}
    return x.withColumns({**out, "separator_obfuscation": F.coalesce(F.arrays_overlap("_words", spelled_out(F.col(text))), F.lit(False))}).drop("_words")
