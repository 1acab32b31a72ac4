"""URL filters by a path-template tree per host, with DataFrame functions only.

A rule's verdict comes first. For the other URLs, the paths of each host make a tree:
segments that hold digits become the wildcards `#` (digits alone) or `*`; of the other
segments, level by level, sibling branches that are statistically alike become a wildcard too,
rare ones by the same test as others. Siblings are alike that have the same shape (short codes,
`?`, or words, `*`) and mostly the same follower, a similar mix of what follows, and, where rules have labelled some of a
branch's URLs, the same share of blocked ones by a two-proportion test against all siblings of
its shape. So a template holds labelled and unlabelled URLs of one form. It is rejected when
rules have labelled at least ``MIN_LABELLED`` of its URLs and the smoothed share of blocked
ones reaches ``REJECT``; smoothing draws it to the share under its parent, that to its host's,
and that to the share of all, each by ``WEIGHT`` URLs against its own evidence. A template
without such evidence of its own is allowed: what is known of its host alone rejects nothing.

Scale: URLs are first counted by (host, shape) with map-side combining. A place's sums are
such counts too, of all its branches, then of the place: no window holds a host's or a
place's rows, however many literal segments it has. Sums and verdicts return by joins,
whose large partitions Spark can split. Only the id and the URL are read.

Edge cases: a null URL, or one without `://`, has an empty host and path and, like
templates without labels, is allowed; paths count to their ends, however deep; repeated rows
each come back; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._sql import ascii_lower
from ._store import stored

#: Verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
ALIKE, WEIGHT, REJECT, MIN_LABELLED = 0.2, 2.0, 0.8, 3


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.char_length(host) + 1, F.char_length(rest)), "^[^?#]*", 0)
    return ascii_lower(host), path


def ruled(rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule, and its verdict; null without."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def shape(path: Column) -> Column:
    """A path's segments, with what surely varies as wildcards."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    ending = lambda s: F.regexp_extract(s, r"(\.[A-Za-z]{1,5})$", 1)
    return F.transform(segments, lambda s: F.when(s.rlike(r"^[0-9]+(\.[A-Za-z]{1,5})?$"), F.concat(F.lit("#"), ending(s))).when(s.rlike("[0-9]") | (F.char_length(s) > 24), F.concat(F.lit("*"), ending(s))).otherwise(s))


def kin(seg: Column) -> Column:
    """The form of a literal segment, which is also the wildcard of alike ones."""
    return F.when(seg.rlike("^[A-Za-z]{1,3}$"), "?").otherwise("*")


def templates(counted: DataFrame) -> DataFrame:
    """(host, shape, template, purity, seen) from counts (n, labelled, blocked) by host and shape.

    All places of the tree, given by host and template so far (``under``), grow at once: first
    by what all their paths have in common, then by one segment where they branch. Places
    without branches are done, so the turns are as many as a path has branching places.
    """
    known = counted.select("host", "shape", F.col("shape").alias("rest"), F.lit("").alias("under"), "n", "labelled", "blocked")
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    named = lambda prefix: [F.col(c).alias(f"{prefix}_{c}") for c in ("n", "labelled", "blocked")]
    below = lambda under, segs: F.concat(under, F.array_join(F.transform(segs, lambda s: F.concat(F.lit("/"), s)), ""))
    done = []
    while not known.isEmpty():
        # the paths of a place have in common what its least and its greatest have
        place = known.groupBy("host", "under").agg(F.min("rest").alias("least"), F.max("rest").alias("most"))
        place = place.select("host", "under", (F.array_position(F.zip_with("least", "most", lambda a, b: a.eqNullSafe(b)), False) - 1).cast("int").alias("common"))
        at = stored(known.join(place, ["host", "under"]), "places")
        done.append(at.where("common < 0").select("host", "shape", below(F.col("under"), F.col("rest")).alias("template"), "labelled", "blocked"))
        at = at.where("common >= 0").withColumn("under", below(F.col("under"), F.slice("rest", F.lit(1), F.greatest("common", F.lit(0))))).withColumn("seg", F.get("rest", F.col("common")))
        done.append(at.where("seg IS NULL").select("host", "shape", F.col("under").alias("template"), "labelled", "blocked"))
        at = at.withColumn("follow", F.coalesce(F.get("rest", F.col("common") + 1), F.lit("/")))
        # sums by branch and follower, and of these by branch, and by follower and in all of each form (shape and first follower); wildcards and ends of paths stay what they are
        mix = stored(at.where(~F.col("seg").rlike("^[#*]")).groupBy("host", "under", "seg", "follow").agg(*sums), "mixes")
        branch = mix.groupBy("host", "under", "seg").agg(*sums, F.max(F.struct("n", "follow"))["follow"].alias("lead"))
        mix = mix.join(branch.select("host", "under", "seg", F.concat(kin(F.col("seg")), "lead").alias("kin")), ["host", "under", "seg"])
        every = mix.groupBy("host", "under", "kin", "follow").agg(F.sum("n").alias("every"))
        whole = mix.groupBy("host", "under", "kin").agg(*sums).select("host", "under", "kin", *named("all"))
        # a branch's mix of followers against all siblings' of its form
        both = mix.select("host", "under", "kin", "seg", "follow", F.col("n").alias("both"))
        both = both.join(branch.select("host", "under", "seg", *named("own")), ["host", "under", "seg"]).join(every, ["host", "under", "kin", "follow"]).join(whole, ["host", "under", "kin"])
        apart = F.sum(F.abs(F.col("both") / F.col("own_n") - F.col("every") / F.col("all_n"))) / 2
        tested = both.where("own_n < all_n").groupBy("host", "under", "kin", "seg", "own_labelled", "own_blocked", "all_labelled", "all_blocked").agg(apart.alias("apart"))
        own, every_l = F.nullif("own_labelled", F.lit(0)), F.nullif("all_labelled", F.lit(0))
        p, q = F.col("own_blocked") / own, F.col("all_blocked") / every_l
        near = F.abs(p - q) <= 1.96 * F.sqrt(q * (1 - q) * (1 / own + 1 / every_l)) + 1e-9
        alike = tested.where(F.coalesce(near, F.lit(True)) & (F.col("apart") <= ALIKE)).select("host", "under", "seg", kin(F.col("seg")).alias("name"))
        rest = F.slice("rest", F.col("common") + 2, F.size("rest"))
        known = at.where("seg IS NOT NULL").join(alike, ["host", "under", "seg"], "left")
        known = stored(known.select("host", "shape", rest.alias("rest"), F.concat("under", F.lit("/"), F.coalesce("name", "seg")).alias("under"), "n", "labelled", "blocked"), "branches")
    tree = counted.select("host", "shape", F.lit("/").alias("template"), "labelled", "blocked").limit(0)
    for part in done:
        tree = tree.unionByName(part)
    tree = tree.withColumn("template", F.when(F.col("template") == "", "/").otherwise(F.col("template")))
    every = counted.agg(F.sum("labelled").alias("all_l"), F.sum("blocked").alias("all_b")).first()
    share = (every["all_b"] or 0) / max(1, every["all_l"] or 0)
    drawn = lambda blocked, labelled, to: (blocked + WEIGHT * to) / (labelled + WEIGHT)
    host = counted.groupBy("host").agg(drawn(F.sum("blocked"), F.sum("labelled"), F.lit(share)).alias("of_host"))
    own = tree.groupBy("host", "template").agg(F.sum("blocked").alias("own_b"), F.sum("labelled").alias("seen")).withColumn("parent", F.regexp_replace("template", "[^/]*$", ""))
    parent = own.groupBy("host", "parent").agg(F.sum("own_b").alias("up_b"), F.sum("seen").alias("up_l")).join(host, "host")
    parent = parent.select("host", "parent", drawn(F.col("up_b"), F.col("up_l"), F.col("of_host")).alias("of_parent"))
    pure = own.join(parent, ["host", "parent"]).select("host", "template", drawn(F.col("own_b"), F.col("seen"), F.col("of_parent")).alias("purity"), "seen")
    return tree.select("host", "shape", "template").join(pure, ["host", "template"]).select("host", "shape", "template", "purity", "seen")


def judged(pages: DataFrame, *keep: str, column: str = "url", rules=RULES) -> DataFrame:
    """The columns ``keep`` with host, path, rule, verdict, template and purity."""
    host, path = parts(F.coalesce(F.col(column), F.lit("")))
    rows = pages.select(*keep, host.alias("host"), path.alias("path"))
    rule, verdict = ruled(rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict).withColumn("shape", shape(F.col("path")))
    count = [F.count("*").alias("n"), F.count("ruled").alias("labelled"), F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked")]
    counted = stored(rows.groupBy("host", "shape").agg(*count), "shapes")
    known = templates(counted)
    learned = F.when((F.col("purity") >= REJECT) & (F.col("seen") >= MIN_LABELLED), "block").otherwise("allow")
    return rows.join(known, ["host", "shape"], "left").select(*keep, "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "template", F.round("purity", 6).alias("purity"))
