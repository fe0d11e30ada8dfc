"""URL filters: path-template trees per host, merged and judged by smoothed labelled purity, under fixed rules.

1. Host and path are cut out of the URL. The longest fixed rule that fits decides: hosts are matched with all their
   parent domains by an equality join on suffixes, never by a cross join.
2. All others are judged by the method. Distinct (host, path) pairs are counted first, so a host with a third of all
   rows arrives as its distinct paths. Paths become segments, and every segment has a shape (digits, hexadecimal,
   words, ...). A place in the tree is the host, the shapes in front, and the segment's own shape. Where a place has
   many values, none of them dominant, its segments are variable and become a wildcard named after the shape: this
   gives the template of a path.
3. The tree of a host has the templates' prefixes as nodes. Labelled rows give each node a count of bad and of all
   labels, and all rows give it a profile: which shapes of segments follow, and how often. A branch is merged with its
   siblings into a wildcard branch if nothing tells it from the rest of them: where it has labels, a two-proportion test
   on these; where it has none, its own shape and its profile, which may differ in half of its rows at most. So a branch
   without labels inherits those of branches built like it; branches that differ keep their literal.
4. The purity of a merged template is its share of bad labels, smoothed towards its host's. In a host's share rows
   without a label count as the share of all labels, so a few labelled paths do not condemn a host.
5. Templates at or above a threshold are blocked. It comes from the labels: half of the labelled paths, by a hash, give
   purities, and the threshold is the one above the share of bad labels (which is what a template without any evidence
   gets) that tells bad from good best on the other half; of equally good ones the highest.

Sums are combined inside tasks before they are shuffled; a tree is never collected. Rows and paths meet what is known of
their URL, place or template by joins that spread the largest groups over many tasks, since one host or one URL may hold
a third of all rows; inside the tree there is one row per template and depth. The labels of the registered query are the URLs that fixed rules decide, since there is no other label of
pages; a caller may bring labelled URLs.

Defined cases: a NULL URL or one without ``://`` has an empty host and path, fits no rule and is judged as the template
of that host; NULL keys and repeated rows are kept; labels that are NULL are ignored; without labels nothing is
rejected; an empty table gives an empty result. Only the key and the URL are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlint.llm.common import lower_ascii, stored
from ledgerlint.operators.skew import join_to_groups

#: Fixed rules of the query: (domain, start of the path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
         ("org", "/fr/", "allow"))
MANY_VALUES = 8
DOMINANT = 0.5
SIMILAR = 1.96
#: The most that the profile of an unlabelled branch may differ from its siblings', as a share of rows.
UNLIKE = 0.5
HOST_WEIGHT, TEMPLATE_WEIGHT = 20.0, 5.0
#: Thresholds tried on held-out labels, and the one without labels: nothing is rejected.
STEPS = 20
NO_LABELS = 2.0


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def by_rules(places: DataFrame, rules=RULES) -> DataFrame:
    """``host``, ``path`` with the ``rule`` that decides (domain and path joined) and its ``verdict``; else NULL.

    The longest rule wins: the longest domain, then the longest path. Rules are a short list of the caller's.
    """
    spark = places.sparkSession
    table = spark.createDataFrame([(d, p, v, d + p) for d, p, v in rules],
                                  "domain string, start string, rule_verdict string, rule string")
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels) - i + 1), "."))
    suffixes = places.select("host", "path", F.explode(domains).alias("domain"))
    fitting = suffixes.join(F.broadcast(table), "domain").where(F.expr("startswith(path, start)"))
    # One value per place: the longest rule, its text as the last resort.
    best = fitting.groupBy("host", "path").agg(F.max(F.struct(
        F.length("rule").alias("n"), F.length("domain").alias("m"), "rule", "rule_verdict")).alias("best"))
    found = best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("verdict"))
    return places.join(found, ["host", "path"], "left")


def _shape(segment: Column) -> Column:
    """The shape of a path segment, with its ending: ``12.html`` is digits with .html."""
    ending = F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1)
    name = F.substr(segment, F.lit(1), F.length(segment) - F.length(ending))
    shape = (F.when(name == "", "").when(name.rlike(r"^\d{4}-\d{2}-\d{2}$"), "date").when(name.rlike(r"^\d+$"), "number")
             .when(name.rlike(r"^[0-9a-fA-F-]{8,}$") & name.rlike(r"\d"), "hex")
             .when(name.rlike(r"\d"), "mixed").when(name.rlike("[-_+]"), "slug").otherwise("word"))
    return F.concat(F.lit("<"), shape, F.lit(">"), ending)


def templates(places: DataFrame) -> DataFrame:
    """``places`` (host, path, n, ...) with ``template``: an array of segments, variable ones as their shape."""
    segments = places.withColumn("segments", F.split("path", "/"))
    shaped = segments.withColumn("shapes", F.transform("segments", _shape))
    slots = shaped.select("host", "path", "n", "segments", "shapes", F.posexplode_outer("segments").alias("at", "value"))
    slots = slots.select("host", "path", "n", "at", "value", F.array_join(
        F.slice("shapes", 1, F.col("at") + 1), "/").alias("slot"))
    values = slots.groupBy("host", "slot", "value").agg(F.sum("n").alias("n"))
    spread = values.groupBy("host", "slot").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("n"),
                                                F.max("n").alias("most"))
    variable = stored(spread.select("host", "slot", F.col("values").alias("places"), (
        (F.col("values") >= MANY_VALUES) & (F.col("most") < DOMINANT * F.col("n"))).alias("variable")), "slots")
    chosen = join_to_groups(slots, variable, ["host", "slot"], "places", ["path"]).groupBy("host", "path").agg(
        F.array_sort(F.collect_list(F.struct("at", "variable"))).alias("v"))
    template = F.transform("segments", lambda s, i: F.when(
        F.get("v", i)["variable"], F.get("shapes", i)).otherwise(s))
    return shaped.join(chosen, ["host", "path"]).withColumn("template", template).drop("segments", "shapes", "v")


def _bare_shape(segment: Column) -> Column:
    """The shape of a segment of a template, which may be a shape already; empty where the path ends."""
    return F.when(segment.isNull(), "").when(segment.rlike("^<[a-z]*>"), segment).otherwise(_shape(segment))


def merged(counted: DataFrame) -> DataFrame:
    """``counted`` (host, template, labelled, bad, n) with ``merged``: the template with branches like their siblings
    replaced by ``*``."""
    nodes = counted.select("host", "template", "labelled", "bad", "n", F.posexplode_outer("template").alias("at", "segment"))
    nodes = nodes.select(
        "host", "template", "labelled", "bad", "n", "at", F.coalesce("segment", F.lit("")).alias("segment"),
        # The depth is part of the parent: no segment in front and one empty segment are different places.
        F.concat_ws("/", F.coalesce("at", F.lit(0)).cast("string"), F.slice("template", 1, F.col("at"))).alias("parent"),
        _bare_shape(F.get("template", F.col("at") + 1)).alias("follows"))
    shapes = stored(nodes.groupBy("host", "parent", "segment", "follows").agg(
        F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.sum("n").alias("n")), "shapes")
    branches = shapes.groupBy("host", "parent", "segment").agg(
        F.sum("labelled").alias("own_n"), F.sum("bad").alias("own_bad"), F.sum("n").alias("rows"))
    branches = stored(branches.withColumn("own_shape", _bare_shape(F.col("segment"))), "branches")
    parents = branches.groupBy("host", "parent").agg(
        F.sum("own_n").alias("all_n"), F.sum("own_bad").alias("all_bad"), F.count(F.lit(1)).alias("branches"))
    # What a branch without labels is compared with: the labelled siblings of its own shape.
    known = shapes.join(branches.where("own_n > 0").select("host", "parent", "segment", "own_shape"), ["host", "parent", "segment"])
    profile = known.groupBy("host", "parent", "own_shape", "follows").agg(F.sum("n").alias("known"))
    totals = profile.groupBy("host", "parent", "own_shape").agg(F.sum("known").alias("all_known"))
    own = shapes.join(branches.where("own_n = 0").select("host", "parent", "segment", "own_shape", "rows"), ["host", "parent", "segment"])
    met = own.join(totals, ["host", "parent", "own_shape"]).join(profile, ["host", "parent", "own_shape", "follows"], "left")
    shared = met.groupBy("host", "parent", "segment").agg(F.sum(F.least(
        F.col("n") / F.col("rows"), F.coalesce("known", F.lit(0)) / F.col("all_known"))).alias("in_common"))

    rest_n, rest_bad = F.col("all_n") - F.col("own_n"), F.col("all_bad") - F.col("own_bad")
    share = F.col("all_bad") / F.greatest(F.col("all_n"), F.lit(1))
    spread = F.sqrt(share * (1 - share) * (1 / F.greatest(F.col("own_n"), F.lit(1)) + 1 / F.greatest(rest_n, F.lit(1))))
    apart = F.abs(F.col("own_bad") / F.greatest(F.col("own_n"), F.lit(1)) - rest_bad / F.greatest(rest_n, F.lit(1)))
    unlabelled = (F.col("all_n") == 0) | (F.coalesce("in_common", F.lit(0.0)) >= 1 - UNLIKE)
    labelled = (apart <= SIMILAR * spread) | (rest_n == 0)
    alike = (F.col("branches") > 1) & F.when(F.col("own_n") == 0, unlabelled).otherwise(labelled)
    judged = branches.join(parents, ["host", "parent"]).join(
        shared, ["host", "parent", "segment"], "left").select("host", "parent", "segment", alike.alias("alike"))
    chosen = nodes.join(judged, ["host", "parent", "segment"]).groupBy("host", "template").agg(
        F.array_sort(F.collect_list(F.struct("at", F.when(F.col("alike"), F.lit("*")).otherwise(
            F.col("segment")).alias("s")))).alias("m"))
    return counted.join(chosen, ["host", "template"]).withColumn(
        "merged", F.array_join(F.transform("m", lambda x: x["s"]), "/")).drop("m")


def purities(counted: DataFrame) -> DataFrame:
    """``host``, ``template`` (array), ``merged``, ``purity`` (share of bad labels, smoothed); ``counted`` has the rows
    ``n`` of each template beside its labels."""
    whole = stored(merged(counted), "templates")
    total = whole.agg(F.sum("labelled").alias("n"), F.sum("bad").alias("bad")).first()
    overall = (total["bad"] or 0) / total["n"] if total["n"] else 0.0
    hosts = whole.groupBy("host").agg(F.sum("labelled").alias("host_n"), F.sum("bad").alias("host_bad"),
                                      F.greatest(F.sum("n"), F.sum("labelled")).alias("host_rows"))
    unknown = F.col("host_rows") - F.col("host_n") + HOST_WEIGHT
    prior = (F.col("host_bad") + overall * unknown) / (F.col("host_rows") + HOST_WEIGHT)
    groups = whole.groupBy("host", "merged").agg(F.sum("labelled").alias("labels"), F.sum("bad").alias("b"))
    groups = groups.join(hosts, "host").select("host", "merged", (
        (F.col("b") + TEMPLATE_WEIGHT * prior) / (F.col("labels") + TEMPLATE_WEIGHT)).alias("purity"))
    return whole.join(groups, ["host", "merged"]).select("host", "template", "merged", "purity")


def _counted(places: DataFrame, labels: Column) -> DataFrame:
    """Rows and labels of each template; only labels where ``labels`` holds count."""
    def total(c: str) -> Column:
        return F.sum(F.when(labels, F.coalesce(c, F.lit(0))).otherwise(0))

    return places.groupBy("host", "template").agg(total("labelled").alias("labelled"), total("bad").alias("bad"), F.sum("n").alias("n"))


def threshold(places: DataFrame) -> float:
    """The purity above the share of bad labels that tells bad from good labels best (by the mean of both shares told
    right) on paths whose labels did not count; of equally good ones the highest. At most ``STEPS`` rows come to the driver."""
    learned = F.pmod(F.xxhash64("host", "path"), F.lit(2)) == 0
    found = purities(_counted(places, learned)).select("host", "template", "purity")
    held = places.where(~learned & (F.col("labelled") > 0)).join(found, ["host", "template"])
    step = F.least(F.floor(F.col("purity") * STEPS), F.lit(STEPS - 1)).cast("int")
    counts = {r["step"]: r for r in held.groupBy(step.alias("step")).agg(
        F.sum("bad").alias("bad"), F.sum(F.col("labelled") - F.col("bad")).alias("good")).collect()}
    bad, good = (sum(r[c] for r in counts.values()) for c in ("bad", "good"))
    if not bad or not good:
        return 0.5 if bad else NO_LABELS
    best = (0.0, NO_LABELS)
    for border in range(int(bad / (bad + good) * STEPS) + 1, STEPS):
        right = (sum(r["bad"] for s, r in counts.items() if s >= border) / bad
                 + sum(r["good"] for s, r in counts.items() if s < border) / good)
        best = max(best, (right, border / STEPS))
    return best[1]


def judge(pages: DataFrame, labels: DataFrame | None = None, key: str = "page_id", url: str = "url",
          rules=RULES) -> DataFrame:
    """One row per page: key, host, path, rule, verdict, template, purity.

    ``labels`` has ``url`` and ``bad`` (0 or 1) of any URLs; without it the URLs that rules decide are the labels.
    """
    rows = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    places = stored(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")), "places")
    ruled = by_rules(places, rules)
    if labels is None:
        known = ruled.where(F.col("rule").isNotNull()).select(
            "host", "path", F.col("n").alias("labelled"), (F.col("n") * (F.col("verdict") == "block").cast(
                "long")).alias("bad"))
    else:
        known = labels.where(F.col("bad").isNotNull()).select(
            host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("bad").cast("long").alias(
                "bad")).groupBy("host", "path").agg(F.count(F.lit(1)).alias("labelled"), F.sum("bad").alias("bad"))
    places = stored(templates(ruled.join(known, ["host", "path"], "left")), "paths")
    border = threshold(places)
    # One row per template, with the paths that have it as weight.
    found = purities(_counted(places, F.lit(True))).select("host", "template", "merged", "purity")
    paths = places.groupBy("host", "template").agg(F.count(F.lit(1)).alias("paths"))
    judged = join_to_groups(
        places.select("host", "path", "rule", "verdict", "n", "template"),
        stored(found.join(paths, ["host", "template"]), "purities"), ["host", "template"], "paths", ["path"])
    judged = stored(judged.select(
        "host", "path", "rule", "n", F.coalesce("verdict", F.when(F.col("purity") >= border, "block").otherwise(
            "allow")).alias("verdict"), F.col("merged").alias("template"), "purity"), "judged")
    return join_to_groups(rows, judged, ["host", "path"], "n", ["key"]).select(
        F.col("key").alias(key), "host", "path", "rule", "verdict", "template", "purity")
