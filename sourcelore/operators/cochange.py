"""Files that change in the same commits.

``correlation`` of a file with a partner is the share of the file's commits that also touch
the partner, so it is not symmetric.

Pairing every file of a commit with every other grows with the square of the commit, and
one bulk commit (an import, a reformatting) may hold a large part of the log. Commits are
therefore counted in two exact ways that add up:

* commits of at most ``bulk_size`` files are paired file by file, which emits at most
  ``bulk_size / 2`` rows per log row. These rows are two numbers of files and a bound; paths are
  looked up for the pairs that may qualify only;
* in larger commits files are first grouped by the exact set of bulk commits they belong
  to. All files of such a group share the same number of bulk commits with any other
  group, so groups are paired instead of files. Files are filled in at the end: all of
  them when the full list is asked for, only the best few when ``top_n`` is given.

Groups are not all paired either. Bulk commits alone make a partner only by sharing at least
``need`` of a group's ``b``, so the partner is met in one of the group's ``b - need + 1``
smallest ones: candidates come from those, and the larger a commit is, the fewer groups look
for partners in it. What two groups share is counted from their sets of commits, right where
they meet, so that only the best pairs, or those of files, leave the task; and once more for
the groups of files that met in an ordinary commit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import attach

BULK_SIZE = 200
#: Places that a group looks for partners in, and files that a row of a group brings along.
SPREAD, AT_A_TIME = 16, 256
#: A share that the division of counts rounds up to the threshold must not be missed.
ROUNDING = 1e-9
#: Deals that files are numbered in, and that commits are gathered by.
DEALS, COMMIT_DEALS = 4096, 65536


def _touches(commit_files: DataFrame, bulk_size: int) -> DataFrame:
    """Distinct rows of a numbered ``commit`` and a file, marked when the commit touches more than ``bulk_size`` files.

    The rows of a commit meet once and are told apart and counted there, sorted and not held: what follows reads them
    many times, and each time all that made them stands in the plan. A number is the same whenever it is computed.
    """
    # Stated once here: the joins below would each add such a filter, to some branches only, and
    # the distinct rows would be shuffled anew for every branch.
    keys = ["repo_id", "hash", "file"]
    rows = commit_files.select(*keys).filter(" and ".join(f"{key} is not null" for key in keys))
    # Dealt by a column of its own: a repository that is the same in all rows is dropped from some keys only.
    deal = F.pmod(F.xxhash64("repo_id", "hash"), F.lit(COMMIT_DEALS)).cast("int")
    rows = rows.withColumn("deal", deal).repartition("deal").dropDuplicates(["deal", *keys])
    place = F.dense_rank().over(Window.partitionBy("deal").orderBy("hash", "repo_id"))
    size = F.count("*").over(Window.partitionBy("deal", "hash", "repo_id"))
    commit = place.cast("long") * COMMIT_DEALS + F.col("deal")
    touches = rows.withColumn("commit", commit).withColumn("size", size).select("repo_id", "commit", "file", "size")
    return touches.withColumn("bulk", F.col("size") > bulk_size)


def _per_file(touches: DataFrame, targets: DataFrame | None) -> DataFrame:
    """Per file: its number of commits, those of them that are bulk, whether partners are wanted, and its bulk group.

    The group is named by the number of bulk commits and two order-free 64-bit digests of
    them; it is null for files in no bulk commit.
    """
    bulk = F.col("bulk")
    grouped = touches.groupBy("repo_id", "file").agg(
        F.count("*").alias("commits"),
        F.count_if(bulk).alias("bulk_commits"),
        F.bit_xor(F.when(bulk, F.xxhash64(F.lit("a"), F.col("commit")))).alias("digest_a"),
        F.bit_xor(F.when(bulk, F.xxhash64(F.lit("b"), F.col("commit")))).alias("digest_b"),
    )
    group = F.when(F.col("bulk_commits") > 0, F.concat_ws(":", "bulk_commits", "digest_a", "digest_b"))
    files = grouped.select("repo_id", "file", "commits", "bulk_commits", group.alias("bulk_group"))
    if targets is None:
        return files.withColumn("wanted", F.lit(True))
    wanted = targets.select("repo_id", F.col("path").alias("file"), F.lit(True).alias("wanted")).distinct()
    return files.join(wanted, ["repo_id", "file"], "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))


def _numbered(files: DataFrame) -> DataFrame:
    """Files with an ``id`` of their own, a small number that is the same whenever it is computed.

    Files are dealt by hash and numbered within each deal, so no task numbers all of them.
    """
    deal = F.pmod(F.xxhash64("repo_id", "file"), F.lit(DEALS))
    # Ordered by all columns: files differ in the first two, but so all that is read of them comes from one shuffle.
    place = F.row_number().over(Window.partitionBy("deal").orderBy("repo_id", "file", "commits", "bulk_group", "wanted"))
    return files.withColumn("deal", deal).withColumn("id", place.cast("long") * DEALS + F.col("deal")).drop("deal")


def _need(threshold: float) -> Column:
    """Commits that a file must share with a partner, rounding taken care of."""
    return F.greatest(F.lit(1), F.ceil(F.col("commits") * threshold - ROUNDING)).cast("long")


def _pairs_by_file(touches: DataFrame, files: DataFrame, threshold: float) -> DataFrame:
    """Shared ordinary commits of each ordered pair that may qualify; each unordered pair is counted once.

    Pairs are many, and most share too little: they are counted by the files' numbers, and only those that qualify for
    either file, if all bulk commits that both may have are shared as well, get paths and groups.
    """
    need = F.when(F.col("wanted"), _need(threshold)).alias("need")
    known = files.select("repo_id", "file", "id", "bulk_commits", need)
    rows = attach(touches.filter(~F.col("bulk")).select("repo_id", "commit", "file"), known, ["repo_id", "file"]).drop("repo_id", "file")
    left, right = rows.alias("l"), rows.alias("r")
    met = left.join(
        right,
        (F.col("l.commit") == F.col("r.commit"))
        & (F.col("l.id") < F.col("r.id"))
        & (F.col("l.need").isNotNull() | F.col("r.need").isNotNull()),
    )
    # The least of the numbers given; what a pair needs is the same in all its rows.
    least = F.least("l.need", "r.need") - F.least("l.bulk_commits", "r.bulk_commits")
    counted = (
        met.select(F.col("l.id").alias("l"), F.col("r.id").alias("r"), least.cast("int").alias("least"))
        .groupBy("l", "r")
        .agg(F.count("*").alias("shared"), F.max("least").alias("least"))
        .filter("shared >= least")
    )
    both = F.array(F.struct(F.col("l").alias("id"), F.col("r").alias("other")), F.struct(F.col("r").alias("id"), F.col("l").alias("other")))
    pairs = counted.select("shared", F.explode(both).alias("d")).select("d.*", "shared")
    mine = files.filter("wanted").select(
        "id", "repo_id", F.col("file").alias("path"), "commits", F.col("bulk_commits").alias("path_bulk"), F.col("bulk_group").alias("path_group"), _need(threshold).alias("need")
    )
    others = files.select(F.col("id").alias("other"), "file", F.col("bulk_commits").alias("file_bulk"), F.col("bulk_group").alias("file_group"))
    pairs = attach(pairs, mine, ["id"]).filter("shared + path_bulk >= need").drop("id")
    pairs = attach(pairs, others, ["other"]).filter("shared + least(path_bulk, file_bulk) >= need")
    return pairs.select("repo_id", "path", "file", "commits", "path_group", "file_group", "shared")


def _groups(touches: DataFrame, files: DataFrame, threshold: float) -> DataFrame:
    """Per bulk group: its bulk commits with their sizes, smallest first, and how many of them a partner must share.

    ``need`` is that of the member that asks for least, null where no member's partners are wanted; ``need_alone`` and
    ``need_rest`` are those of members in bulk commits only, and of the others. The first file stands for the others of
    its group, so a row is as long as the repository has bulk commits at most.
    """
    need = _need(threshold).cast("int")
    groups = (
        files.filter(F.col("bulk_group").isNotNull())
        .groupBy("repo_id", "bulk_group")
        .agg(
            F.min("file").alias("file"),
            F.count("*").alias("members"),
            F.min(F.when(F.col("wanted"), need)).alias("need"),
            F.min(F.when(F.col("wanted") & _alone(), need)).alias("need_alone"),
            F.min(F.when(F.col("wanted") & ~_alone(), need)).alias("need_rest"),
        )
    )
    rows = attach(touches.filter("bulk").select("repo_id", "commit", "file", "size"), groups, ["repo_id", "file"])
    bulk = F.array_sort(F.collect_list(F.struct("size", "commit")))
    same = [F.min(c).alias(c) for c in ("file", "members", "need", "need_alone", "need_rest")]
    return rows.groupBy("repo_id", "bulk_group").agg(bulk.alias("bulk"), *same)


def _alone() -> Column:
    """Whether a file is in bulk commits only; a group's name starts with the number of its bulk commits."""
    return F.substring_index("bulk_group", ":", 1).cast("long") == F.col("commits")


def _group_candidates(groups: DataFrame) -> DataFrame:
    """Pairs of rows that may share enough bulk commits, each row with itself included, and how many they share.

    Columns come as ``path_…`` and ``file_…``. A pair is made at the smallest commit that both share, so it comes once
    and is counted where it is made: no pairs are shuffled. Rows that look for partners go to ``SPREAD`` places each, as
    one commit may hold a large part of the others.
    """
    sides = {
        side: groups.withColumn("bulk", F.col("bulk.commit")).select(
            "repo_id", *[F.col(c).alias(f"{side}_{c.removeprefix('bulk_')}") for c in groups.columns if c != "repo_id"]
        )
        for side in ("path", "file")
    }
    searched = sides["path"].filter(F.col("path_need") <= F.size("path_bulk"))
    searched = searched.withColumn("met", F.explode(F.expr("slice(path_bulk, 1, size(path_bulk) - path_need + 1)")))
    searched = searched.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    held = sides["file"].withColumn("met", F.explode("file_bulk"))
    held = held.withColumn("place", F.pmod(F.xxhash64("file_group", "file_file"), F.lit(SPREAD)).cast("int"))
    tasks = max(32, 4 * groups.sparkSession.sparkContext.defaultParallelism)
    keys = ["repo_id", "met", "place"]
    common = F.array_intersect("path_bulk", "file_bulk")
    return (
        searched.repartition(tasks, *keys)
        .join(held.repartition(tasks, *keys), keys)
        .filter((F.size("file_bulk") >= F.col("path_need")) & (F.get(common, F.lit(0)) == F.col("met")))
        .withColumn("bulk_shared", F.size(common).cast("long"))
        .drop("met", "place", "path_bulk", "file_bulk")
    )


def _group_overlaps(candidates: DataFrame, groups: DataFrame) -> DataFrame:
    """Shared bulk commits of the given pairs of groups."""
    sets = groups.select("repo_id", "bulk_group", F.col("bulk.commit").alias("bulk"))
    for side in ("path", "file"):
        candidates = attach(candidates, sets.select("repo_id", F.col("bulk_group").alias(f"{side}_group"), F.col("bulk").alias(f"{side}_bulk")), ["repo_id", f"{side}_group"])
    shared = F.size(F.array_intersect("path_bulk", "file_bulk")).cast("long")
    return candidates.select("repo_id", "path_group", "file_group", shared.alias("bulk_shared"))


def _qualified(pairs: DataFrame, threshold: float) -> DataFrame:
    return pairs.filter((F.col("path") != F.col("file")) & (F.col("bulk_shared") / F.col("commits") >= threshold)).select(
        "repo_id", "path", "file", "commits", F.col("bulk_shared").alias("count")
    )


def _top_pairs_by_group(groups: DataFrame, files: DataFrame, threshold: float, top_n: int) -> DataFrame:
    """The best pairs that qualify by their bulk commits alone, at least ``top_n`` of a file that has as many.

    The best partners of a file outside its own row are among the first top_n + 1 of its group's partners. Those are in
    the first top_n + 1 of its partner groups, by shared commits and first file, and among the first top_n + 1 files of each.
    """
    members = files.filter(F.col("bulk_group").isNotNull())

    def first(rows: DataFrame, group: str, *order: Column) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("repo_id", group).orderBy(*order))
        return rows.withColumn("place", place).filter(F.col("place") <= top_n + 1).drop("place")

    pairs = _group_candidates(groups).filter("bulk_shared >= path_need")
    pairs = first(pairs.select("repo_id", "path_group", "file_group", "file_file", "bulk_shared"), "path_group", F.desc("bulk_shared"), F.col("file_file"))
    partners = first(members.select("repo_id", F.col("bulk_group").alias("file_group"), "file"), "file_group", F.col("file"))
    by_group = pairs.select("repo_id", "path_group", "file_group", "bulk_shared").join(partners, ["repo_id", "file_group"])
    by_group = first(by_group, "path_group", F.desc("bulk_shared"), F.col("file"))
    mine = members.filter("wanted").select("repo_id", F.col("bulk_group").alias("path_group"), F.col("file").alias("path"), "commits")
    return _qualified(attach(mine, by_group, ["repo_id", "path_group"]), threshold)


def _all_pairs_by_group(groups: DataFrame, files: DataFrame, threshold: float, alone: bool) -> DataFrame:
    """All pairs that qualify by their bulk commits alone, of files in bulk commits only (``alone``) or of the others.

    Groups bring their files along, some at a time, so that pairs of files are written where their groups meet.
    """
    need = "need_alone" if alone else "need_rest"
    members = files.filter(F.col("bulk_group").isNotNull())
    part = F.pmod(F.xxhash64("file"), F.ceil(F.col("members") / AT_A_TIME))
    lists = (
        attach(members, groups.select("repo_id", "bulk_group", "members"), ["repo_id", "bulk_group"])
        .groupBy("repo_id", "bulk_group", part.alias("part"))
        .agg(
            F.collect_list("file").alias("files"),
            F.collect_list(F.when(F.col("wanted") & (_alone() == F.lit(alone)), F.struct("file", "commits"))).alias("asking"),
            F.min("file").alias("file"),
        )
    )
    with_files = attach(lists, groups.select("repo_id", "bulk_group", "bulk", F.col(need).alias("need")), ["repo_id", "bulk_group"])
    pairs = _group_candidates(with_files.drop("part")).filter("bulk_shared >= path_need")
    pairs = pairs.select("repo_id", F.explode("path_asking").alias("mine"), "file_files", "bulk_shared")
    pairs = pairs.select("repo_id", F.col("mine.file").alias("path"), "mine.commits", F.explode("file_files").alias("file"), "bulk_shared")
    return _qualified(pairs, threshold)


def co_change(
    commit_files: DataFrame,
    threshold: float = 0.3,
    top_n: int | None = None,
    targets: DataFrame | None = None,
    bulk_size: int = BULK_SIZE,
) -> DataFrame:
    """Partners of each file with a correlation of at least ``threshold``.

    ``targets`` (repo_id, path) limits whose partners are listed; partners may be any file
    of the log. ``top_n`` keeps the best partners of each file, ties by name, and adds
    ``rank``. ``bulk_size`` changes the way of counting only, never the result.
    """
    touches = _touches(commit_files, bulk_size)
    files = _numbered(_per_file(touches, targets))
    groups = _groups(touches, files, threshold)

    by_file = _pairs_by_file(touches, files, threshold)
    in_groups = F.col("path_group").isNotNull() & F.col("file_group").isNotNull()
    enough = F.col("shared") / F.col("commits") >= threshold
    # Pairs that no bulk commit can lift are settled here; a group's name starts with the number of its bulk commits.
    most = F.least(*[F.substring_index(f"{side}_group", ":", 1).cast("long") for side in ("path", "file")])
    lifted = in_groups & ((F.col("shared") + most) / F.col("commits") >= threshold)
    met = by_file.filter(lifted).select("repo_id", "path_group", "file_group").distinct()
    overlaps = _group_overlaps(met, groups)
    # The rest meet their overlap; rows outside the groups are spread by their own path, not gathered under one key.
    looked_up = by_file.filter(enough | lifted).withColumn(
        "path_group", F.when(in_groups, F.col("path_group")).otherwise(F.concat(F.lit("-"), F.col("path")))
    )
    by_file = attach(looked_up, overlaps, ["repo_id", "path_group", "file_group"], "left").select(
        "repo_id",
        "path",
        "file",
        "commits",
        (F.col("shared") + F.coalesce("bulk_shared", F.lit(0))).alias("count"),
    )
    if top_n is None:
        by_group = _all_pairs_by_group(groups, files, threshold, alone=False)
    else:
        by_group = _top_pairs_by_group(groups, files, threshold, top_n)

    # A pair found both ways has its full count on the file side, which is never the smaller.
    pairs = by_file.unionByName(by_group).groupBy("repo_id", "path", "file").agg(F.max("count").alias("count"), F.max("commits").alias("commits"))
    if top_n is None:
        # Files in bulk commits only are found one way only: their pairs need not be gathered.
        pairs = pairs.unionByName(_all_pairs_by_group(groups, files, threshold, alone=True).select(*pairs.columns))
    pairs = pairs.withColumn("correlation", F.col("count") / F.col("commits")).filter(F.col("correlation") >= threshold).drop("commits")
    if top_n is None:
        return pairs
    order = Window.partitionBy("repo_id", "path").orderBy(F.desc("correlation"), "file")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n)
    return ranked.withColumn("rank", F.col("rank").cast("bigint"))


def top_co_change(
    commit_files: DataFrame, threshold: float = 0.3, targets: DataFrame | None = None, top_n: int = 5
) -> DataFrame:
    """The five strongest partners of each file."""
    return co_change(commit_files, threshold, top_n=top_n, targets=targets)
