"""robots.txt: rules as rows, quality, and which URLs they allow."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.functions.numbers import grade
from webloom.operators.automata import pack_rules
from webloom.session import ship
from webloom.storage import materialize

#: Agents and path prefixes that the quality score looks for.
AGENTS = ("gptbot", "claudebot", "claude-web", "googlebot-ai", "perplexitybot", "bingbot", "anthropic-ai", "cohere-ai", "chatgpt-user")
SENSITIVE = ("/admin", "/account", "/cart", "/checkout", "/login", "/auth", "/api/private", "/user", "/profile")


def parse(files: DataFrame, key: str = "url", content: str = "content") -> DataFrame:
    """One row per line that says something: key, line_no, kind (comment, sitemap, user-agent, allow, disallow, other), user_agent, value.

    A rule belongs to the last user-agent line above it, or to '*'; what follows a directive's colon is its value, comments at the end of a
    line included; a file that is null or empty has no rows."""
    lines = files.select(key, F.posexplode(F.split(content, r"\r?\n")).alias("line_no", "_line")).withColumn("_line", F.regexp_replace("_line", r"^\s+|\s+$", ""))
    rows = lines.filter("_line <> ''").select(key, "line_no", *(c.alias(k) for k, c in _mark(F.col("_line")).items()))
    above = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    agent = F.coalesce(F.last(F.when(F.col("kind") == "user-agent", F.col("value")), ignorenulls=True).over(above), F.lit("*"))
    return rows.select(key, "line_no", "kind", agent.alias("user_agent"), "value")


def _mark(line: Column) -> dict[str, Column]:
    """Kind and value of a trimmed line."""
    name = F.lower(F.regexp_extract(line, r"^([A-Za-z-]+):", 1))
    value = F.regexp_replace(F.regexp_extract(line, r"^[A-Za-z-]+:(.*)$", 1), r"^\s+|\s+$", "")
    kind = F.when(F.startswith(line, F.lit("#")), "comment").when(name.isin("sitemap", "user-agent", "allow", "disallow"), name).otherwise("other")
    return {"kind": kind, "value": F.when(kind == "comment", F.regexp_replace(line, r"^#\s*", "")).otherwise(value)}


def quality(files: DataFrame, key: str = "url", content: str = "content") -> DataFrame:
    """Score (0 to 100), label, what was counted, and lists of issues and recommendations of every file; one without content is 'Missing'.

    All within the row, without a shuffle: a file is an array of marked lines."""
    text = F.coalesce(F.col(content), F.lit(""))
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    marks = files.select(key, (text == "").alias("missing"), F.transform(lines, lambda s: F.struct(*(c.alias(k) for k, c in _mark(s).items()))).alias("_marks"))

    def of(*kinds: str, also: Callable[[Column], Column] | None = None) -> Column:
        """Values of the lines of these kinds (with a condition on lower-case values), in order."""
        return F.transform(F.filter("_marks", lambda m: m["kind"].isin(*kinds) & (also(F.lower(m["value"])) if also else F.lit(True))), lambda m: m["value"])

    found = marks.select(
        key,
        "missing",
        F.array_distinct(of("user-agent", also=lambda low: _any(low, F.contains, AGENTS))).alias("ai_agent_names"),
        F.array_distinct(of("disallow", also=lambda low: _any(low, F.startswith, SENSITIVE))).alias("paths"),
        F.size(of("sitemap")).cast("bigint").alias("sitemaps"),
        F.size(of("comment", also=lambda low: _any(low, F.contains, ("llms.txt", "llms-txt")))).cast("bigint").alias("llms_mentions"),
        F.size(of("comment")).cast("bigint").alias("comments"),
        F.size(of("allow", "disallow")).cast("bigint").alias("rules"),
    )
    all_ = found.withColumns({"ai_agents": F.size("ai_agent_names").cast("bigint"), "protected_paths": F.size("paths").cast("bigint")})
    agents, sitemaps, paths, mentions, comments = (F.col(c) for c in ("ai_agents", "sitemaps", "protected_paths", "llms_mentions", "comments"))
    by_agents = F.when(agents >= 3, 30).when(agents >= 1, 20).otherwise(5)
    by_paths = F.when(paths >= 3, 25).when(paths >= 1, 15).otherwise(0)
    by_comments = F.when(comments >= 3, 10).when(comments >= 1, 5).otherwise(0)
    complete = (agents > 0) & (sitemaps > 0) & (paths > 0) & (mentions > 0)
    total = by_agents + F.when(sitemaps > 0, 20).otherwise(0) + by_paths + F.when(mentions > 0, 15).otherwise(0) + by_comments + F.when(complete, 10).otherwise(0)
    score = F.when(F.col("missing"), 0).otherwise(F.least(F.lit(100), total))
    label = F.when(F.col("missing"), "Missing").otherwise(grade(score, [(80, "Excellent"), (60, "Good"), (40, "Fair")], "Poor"))
    # what is said of a file
    issues = said(
        F.col("missing"),
        "There is no robots.txt, or it says nothing",
        (agents == 0, "No crawler of a language model is addressed by name"),
        (sitemaps == 0, "The sitemap is not named"),
        (paths == 0, "Private areas are open to crawlers"),
    )
    advice = said(
        F.col("missing"),
        "Publish a robots.txt with at least one rule",
        (agents.between(1, 2), F.format_string("Address more crawlers of language models by name: three or more, not %d", agents)),
        (agents == 0, "Address crawlers of language models by name"),
        (sitemaps == 0, 'Name the sitemap in a Sitemap line'),
        (paths.between(1, 2), "Close more of the private areas"),
        (paths == 0, "Close private areas such as accounts and carts by Disallow lines"),
        (mentions == 0, "Point to llms.txt in a comment"),
        (comments == 0, "Explain the rules in comments"),
    )
    more = {
        "exists": ~F.col("missing"), "max_score": F.lit(100), "has_ai_agents": agents > 0, "ai_agent_names": F.col("ai_agent_names"), "has_sitemap": sitemaps > 0, "protects_paths": paths > 0, "paths": F.col("paths"), "mentions_llms": mentions > 0,
        "has_comments": comments > 0, "rules": F.col("rules"), "structure": F.when(F.col("missing"), "Unknown").when(agents >= 3, "Excellent").when(agents >= 1, "Good").otherwise("Basic"),
    }
    return all_.select(key, *[v.alias(k) for k, v in more.items()], score.alias("score"), label.alias("quality"), "ai_agents", "sitemaps", "protected_paths", "llms_mentions", "comments", issues.alias("issues"), advice.alias("recommendations"))


def said(missing: Column, if_missing: str, *rules: tuple[Column, Column | str]) -> Column:
    """Texts of all rules that hold, in order, or the one text for a file that is missing."""
    return F.when(missing, F.array(F.lit(if_missing))).otherwise(F.array_compact(F.array(*[F.when(when, F.lit(text) if isinstance(text, str) else text) for when, text in rules])))


def _any(value: Column, test: Callable[[Column, Column], Column], words: tuple[str, ...]) -> Column:
    """Whether ``test`` holds for a value and any of the words."""
    return reduce(or_, (test(value, F.lit(w)) for w in words))


#: Bytes of compiled rules that are sent to all tasks; with more, addresses go to the rules. Tasks that the addresses of one site are spread over then.
BROADCAST_BYTES, SALTS = 32 << 20, 16

_VERDICT = "allow int, pattern string"


def compiled(rules: DataFrame, site: Column) -> DataFrame:
    """(_site, _rules): the rules (kind, value) of each site as one automaton, built once. A site's rules are as many as its file has lines."""
    rows = rules.select(site.alias("_site"), (F.col("kind") == "allow").cast("int").alias("allow"), F.col("value").alias("pattern")).distinct()

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        packed = pack_rules(list(zip(frame["allow"].tolist(), frame["pattern"].tolist(), strict=True)))
        return pd.DataFrame({"_site": frame["_site"].iloc[:1], "_rules": [packed]})

    return rows.groupBy("_site").applyInPandas(build, f"_site {rows.schema['_site'].dataType.simpleString()}, _rules binary")


def _verdicts_here(spark: SparkSession, automata: DataFrame) -> Callable[[Column, Column], Column]:
    """Matching with all automata in every task."""
    packed = spark.sparkContext.broadcast({r["_site"]: bytes(r["_rules"]) for r in automata.collect()})

    @F.pandas_udf(_VERDICT)
    def match(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        ready: dict = {}
        for sites, paths in batches:
            out = []
            for site, path in zip(sites, paths, strict=True):
                if site not in ready and site in packed.value:
                    ready[site] = pickle.loads(packed.value[site])
                found = ready[site].match(path) if site in ready and path is not None else None
                out.append((found[1], found[2]) if found else (None, None))
            yield pd.DataFrame(out, columns=["allow", "pattern"]).astype({"allow": "Int32"})

    return match


def _verdicts_there(keys: DataFrame, automata: DataFrame) -> DataFrame:
    """(_site, _path, allow, pattern): distinct addresses go to SALTS tasks a site, each of which gets the site's automaton first and then reads paths past it."""
    kind = keys.schema["_site"].dataType.simpleString()
    paths = keys.select("_site", "_path", F.pmod(F.xxhash64("_path"), F.lit(SALTS)).alias("_salt"), F.lit(None).cast("binary").alias("_rules"))
    rules = automata.select("_site", F.lit(None).cast("string").alias("_path"), F.explode(F.array(*[F.lit(k).cast("bigint") for k in range(SALTS)])).alias("_salt"), "_rules")
    rows = rules.unionByName(paths).repartition("_site", "_salt").sortWithinPartitions("_site", "_salt", F.col("_rules").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        site, automaton = None, None
        for batch in batches:
            out = []
            for own, path, packed in zip(batch.column("_site").to_pylist(), batch.column("_path").to_pylist(), batch.column("_rules").to_pylist(), strict=True):
                if packed is not None:
                    site, automaton = own, pickle.loads(packed)
                    continue
                found = automaton.match(path) if automaton is not None and site == own and path is not None else None
                if found:
                    out.append({"_site": own, "_path": path, "allow": found[1], "pattern": found[2]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("_site", batch.column("_site").type), ("_path", pa.string()), ("allow", pa.int32()), ("pattern", pa.string())]))

    return rows.select("_site", "_path", "_rules").mapInArrow(run, f"_site {kind}, _path string, {_VERDICT}")


def allowed(pages: DataFrame, rules: DataFrame, user_agent: str = "*", url: str = "url", site: str | None = None) -> DataFrame:
    """pages with column ``allowed`` and the deciding pattern: the longest matching one, 'allow' on a tie; none matching allows.

    ``rules``: user_agent, kind, value (as from ``parse``), of this agent or '*'; with ``site`` (a column of both sides) a page meets its own site's rules only. In a path '*' is anything,
    a final '$' the end, all else literal and from the start. A site's rules are one automaton, which reads a path once however many they are. Where all automata together are small, every
    task has them and no page moves; beyond BROADCAST_BYTES distinct paths go to the automata, and what they find is joined back."""
    spark = ship(pages.sparkSession)
    chosen = rules.filter(F.col("kind").isin("allow", "disallow") & (F.col("value") != "") & F.lower("user_agent").isin(user_agent.lower(), "*"))
    own = F.col(site) if site else F.lit(0)
    automata = materialize(compiled(chosen, own), "path_rules")
    size = automata.agg(F.sum(F.octet_length("_rules").cast("bigint"))).first()[0] or 0
    query = urls.query(F.col(url))
    path = F.concat(urls.path(F.col(url)), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    keyed = pages.withColumns({"_site": own, "_path": path})
    if size <= BROADCAST_BYTES:
        found = keyed.withColumn("_verdict", _verdicts_here(spark, automata)(F.col("_site"), F.col("_path"))).withColumns({"_allow": F.col("_verdict.allow"), "_pattern": F.col("_verdict.pattern")}).drop("_verdict")
    else:
        keys = keyed.select("_site", "_path").distinct()
        found = keyed.join(_verdicts_there(keys, automata).withColumnsRenamed({"allow": "_allow", "pattern": "_pattern"}), ["_site", "_path"], "left")
    return found.withColumns({"allowed": F.coalesce(F.col("_allow") == 1, F.lit(True)), "pattern": F.col("_pattern")}).select(*pages.columns, "allowed", "pattern")


def summary(rows: DataFrame) -> DataFrame:
    """Counts of rules, agents and sitemaps, and the first three agents."""
    return rows.agg(
        F.count_if(F.col("kind").isin("allow", "disallow")).alias("rules"),
        F.count_distinct(F.when(F.col("kind") == "user-agent", F.col("value"))).alias("agents"),
        F.count_if(F.col("kind") == "sitemap").alias("sitemaps"),
        F.slice(F.array_sort(F.collect_set(F.when(F.col("kind") == "user-agent", F.col("value")))), 1, 3).alias("first_agents"),
    )
