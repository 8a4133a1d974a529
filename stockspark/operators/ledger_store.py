"""The stored ledger (S-11, K-03): balances that later queries read.

Movements are appended batch by batch.  Every batch is folded from the stored
balances and written with them by the tasks that fold it, so they are dealt out
once: a file holds a range of products, sorted by month, and a range of months
is read by the files' statistics.  Next to the rows lies an index with one
entry for each (product, chunk): first and last order key, sum ``s``, threshold
``t`` (a start of at least ``t`` refuses nothing), ``start`` and ``end``.  A
chunk is what a batch holds of a product, or the part of it that one task
folded.

Appending a batch touches the products in it only:

1. chunks that end before the product's first new movement stay; the last of
   them gives the opening;
2. chunks that overlap the new movements are read and folded anew with them;
3. the chunks behind are moved by the index alone while their new start is at
   least ``t`` (their rows keep the sum before them, so nothing is rewritten),
   up to the first that keeps its old start; from the first that could refuse,
   the product's rows are read and folded again.

A part of a batch none of whose chunks was moved or folded anew is read as it
was written; the index is joined to the others only.

So a batch that is newer than all before costs what it holds, and a late one
the rows it can change.  A batch becomes visible by one marker
(``CommitLog``): a failed append shows nothing, a repeated one adds nothing.

Movements without a product are in no balance (``rejected_movements``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockspark.operators import ledger as L
from stockspark.session import collect_garbage
from stockspark.sources.commits import CommitLog

KEY = L.KEY
#: Where a chunk's rows lie.
PLACE = ("batch", "part", "chunk")
ENTRY = ("first", "last", "n", "s", "t", "start", "end", "clean", "live")
#: Rows of a file of the store at least, where the movements are few.
ROWS_PER_FILE = 10_000
#: Chunks that are sent to every task rather than joined by a shuffle of the rows.
FEW = 200_000


class LedgerStore:
    def __init__(self, spark: SparkSession, path: str, order_cols=L.ORDER, base_after: int = 20):
        self.spark, self.order, self.base_after = spark, list(order_cols), base_after
        self.log, self.bases = CommitLog(spark, path), CommitLog(spark, f"{path}/base")

    # ------------------------------------------------------------ reading
    def index(self, entry=ENTRY) -> DataFrame | None:
        """The live entries, or some of their columns: a chunk's latest one, unless it was folded anew elsewhere."""
        seqs, base = self.log.batches(), self._base()
        newer = self.log.get("index", [b for b, seq in seqs.items() if seq > base])
        held = self.bases.get("index", [str(base)]) if base else None
        parts = [df.select(KEY, *PLACE, *entry, "live", "seq") if "live" not in entry else
                 df.select(KEY, *PLACE, *entry, "seq") for df in (held, newer) if df is not None]
        if not parts:
            return None
        entries = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        if len(seqs) > 1 and newer is not None:
            entries = entries.groupBy(KEY, *PLACE).agg(F.max_by(F.struct(*dict.fromkeys([*entry, "live"])), "seq").alias("e")
                                                         ).select(KEY, *PLACE, "e.*")
        return entries.where("live").select(KEY, *PLACE, *entry)

    def _base(self) -> int:
        """The sequence number up to which all live entries lie in one base; 0: none yet."""
        return max((int(b) for b in self.bases.batches()), default=0)

    def _rebase(self) -> None:
        """Write the live entries together once ``base_after`` batches have come, so reading the index stays in
        proportion to them."""
        seq = max(self.log.batches().values(), default=0)
        if seq - self._base() >= self.base_after and (index := self.index()) is not None:
            self.bases.put("index", index.withColumn("seq", F.lit(seq)), str(seq))
            self.bases.commit(str(seq))

    def snapshot(self) -> DataFrame:
        """K-03: product_id and current_stock, from the chunk ends alone."""
        return (self.index().groupBy(KEY).agg(F.max_by("end", "last").alias("end"))
                .select(KEY, L.from_cents(F.col("end")).alias("current_stock")))

    def rows(self, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
        """K-02: the movements with balance_before, balance_after and accepted; the months of a date range only."""
        as_written, changed, live = self._parts()
        found = []
        for parts, by_index in ((as_written, False), (changed, True)):
            if not parts:
                continue
            rows = self._part_rows(parts)
            if date_from is not None:
                rows = rows.where(F.col("txn_month") >= date_from[:7])
            if date_to is not None:
                rows = rows.where(F.col("txn_month") <= date_to[:7])
            found.append(self._balances(rows, by_index, live).drop("txn_month"))
        return found[0] if len(found) == 1 else found[0].unionByName(found[1])

    def _parts(self) -> tuple[list, list, int | None]:
        """(batch, part) of the visible rows: of those whose balances are all as written, and of those that need the
        index, with the number of live chunks in these (None: not known).  A part is left out once all of its chunks
        were folded anew elsewhere."""
        seqs, base = self.log.batches(), self._base()
        entries = self.log.get("index", list(seqs))
        if entries is None:
            return [], [], None
        own = F.col("commit") == F.col("batch")
        # a chunk is replaced once at most; one with rows of equal order keys at its front goes by its entry's start
        found = entries.groupBy("batch", "part").agg(
            F.count_if(own).alias("n"), F.count_if(~own).alias("later"), F.count_if(~F.col("live")).alias("replaced"),
            F.count_if(own & F.col("twice")).alias("twice")).collect()               # one row a part
        ids = {self.log.value(b): b for b in seqs}
        as_written, changed, live = [], [], 0
        for r in sorted(found, key=lambda r: (seqs[ids[r["batch"]]], r["part"])):
            if r["replaced"] < r["n"]:
                plain = len(seqs) == 1 or not (r["later"] or r["twice"]) and seqs[ids[r["batch"]]] > base
                (as_written if plain else changed).append((ids[r["batch"]], r["part"]))
                live += 0 if plain else r["n"] - r["replaced"]
        return as_written, changed, None if base else live

    def changes(self, batch_id: str) -> DataFrame | None:
        """The rows that a committed batch added or whose balances it corrected, as ``rows`` has them, and their place
        ``_pos`` among those of a chunk; None if none.

        Exact for the latest batch: a later one may have replaced some of these rows.
        """
        entries = self.log.get("index", [batch_id])
        if entries is None:
            return None
        own = F.col("commit") == F.col("batch")
        live = entries.where("live")
        held = live.groupBy("batch", "part", own.alias("own")).agg(F.count_if("twice").alias("twice")).collect()
        ids = {self.log.value(b): b for b in self.log.batches()}
        added = [(ids[r["batch"]], r["part"]) for r in held if r["own"]]
        moved = [(ids[r["batch"]], r["part"]) for r in held if not r["own"]]
        found = []
        if added:                             # all of what the batch itself wrote
            several = len(ids) > 1 and any(r["twice"] for r in held if r["own"])
            found.append(self._balances(self._part_rows(added), several, keep=("_pos",)))
        if moved:
            rows = self._chosen(live.where(~own), moved)
            found.append(self._balances(rows, True, keep=("_pos",)))
        if not found:
            return None
        return (found[0] if len(found) == 1 else found[0].unionByName(found[1])).drop("txn_month")

    def _balances(self, rows: DataFrame, by_index: bool, live: int | None = None, keep: tuple = ()) -> DataFrame:
        """Rows with their balances; ``by_index``: some of their chunks may have moved, or be folded anew elsewhere;
        ``live``: the number of chunks among them that weren't."""
        after, accepted = F.col("_after"), F.col("_accepted")
        if by_index:
            moved = self.index(("start", "clean"))
            if live is not None and live <= FEW:
                places = rows.select("batch", "part").distinct()
                moved = F.broadcast(moved.join(F.broadcast(places), ["batch", "part"], "left_semi"))
            rows = rows.join(moved, [KEY, *PLACE])
            after = F.when(F.col("clean"), F.col("start") + F.col("pre")).otherwise(after)
            accepted = F.col("clean") | accepted
        rows = rows.withColumn("_new", after).withColumn("accepted", accepted)
        before = F.when(F.col("accepted"), F.col("_new") - F.col("_cents")).otherwise(F.col("_new"))
        return (rows.withColumn("balance_before", L.from_cents(before))
                .withColumn("balance_after", L.from_cents(F.col("_new")))
                .drop(*{"_new", "_after", "_accepted", "_cents", "pre", "_pos", "_lead", "start", "clean", *PLACE}
                      .difference(keep)))

    # ------------------------------------------------------------ appending
    def append(self, movements: DataFrame, batch_id: str) -> bool:
        """Fold and add a batch; False where it is committed already."""
        if self.log.known(batch_id):
            return False
        seq = self.log.next_seq()
        new = movements.where(F.col(KEY).isNotNull())
        index = self.index()
        if new.isEmpty():
            pass
        elif index is None:
            self._write(new, None, batch_id, seq, 1)
        else:
            self._merge(new, index, batch_id, seq)
        self.log.commit(batch_id)
        self._rebase()
        return True

    def _key(self):
        return F.struct(*self.order)

    def _write(self, movements: DataFrame, opening: DataFrame | None, batch: str, seq: int, part: int) -> None:
        """Fold movements from ``opening``, write them as part ``part`` of the batch, and their entries.

        The folding tasks write their rows, fewer tasks where these are few.
        A chunk's rows lie in one file, so each task that reads them for the
        entries sends one row a chunk.
        """
        folded, held, chunks, total = L.fold_rows(movements, self.order, opening)
        if total // ROWS_PER_FILE < chunks:
            folded = folded.coalesce(max(1, total // ROWS_PER_FILE))
        rows = (folded.withColumnRenamed("accepted", "_accepted").drop("_before")
                .withColumn("txn_month", F.date_format("created_at", "yyyy-MM"))
                .sortWithinPartitions("txn_month", KEY, *self.order, "_pos"))
        path = f"{self.log.folder('rows', batch)}/part={part}"
        rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
        held.unpersist()
        self._entries(self.spark.read.schema(rows.schema).parquet(path), batch, seq, part)
        if total >= L.ROWS_PER_CHUNK:
            collect_garbage(self.spark)

    def _entries(self, rows: DataFrame, batch: str, seq: int, part: int) -> None:
        at = lambda pick: F.struct(*[pick(c, "_pos").alias(c) for c in self.order])
        before = F.when(F.col("_accepted"), F.col("_after") - F.col("_cents")).otherwise(F.col("_after"))
        # numbers alone are compared, so rows are hashed and not sorted
        entries = rows.groupBy(KEY, "chunk").agg(
            at(F.min_by).alias("first"), at(F.max_by).alias("last"), F.count("*").alias("n"),
            F.sum("_cents").alias("s"), F.greatest(F.lit(0).cast("bigint"), -F.min("pre")).alias("t"),
            F.max_by(before, F.when(F.col("_lead"), F.col("_pos"))).alias("start"),
            F.max_by("_after", "_pos").alias("end"), (F.count_if("_lead") > 1).alias("twice"))
        entries = (entries.withColumn("batch", F.lit(self.log.value(batch))).withColumn("part", F.lit(part))
                   .withColumn("clean", F.col("start") >= F.col("t")).withColumn("live", F.lit(True)))
        self._put_index(entries, batch, seq, f"folded-{part}")

    def _put_index(self, entries: DataFrame, batch: str, seq: int, name: str) -> None:
        twice = F.col("twice") if "twice" in entries.columns else F.lit(False)
        cols = entries.select(KEY, *PLACE, *ENTRY, twice.alias("twice")).withColumn("seq", F.lit(seq))
        cols.write.mode("overwrite").parquet(f"{self.log.folder('index', batch)}/written={name}")

    def _merge(self, new: DataFrame, index: DataFrame, batch: str, seq: int) -> None:
        touched = new.groupBy(KEY).agg(F.min(self._key()).alias("lo"), F.max(self._key()).alias("hi"))
        mine = L._checkpoint(index.join(touched, KEY))
        ends = mine.where(F.col("last") < F.col("lo")).groupBy(KEY).agg(F.max_by("end", "last").alias("_e"))
        opening = ends.select(KEY, L.from_cents(F.col("_e")).alias("balance"))
        later = mine.where(F.col("last") >= F.col("lo"))
        hit = later.where(F.col("first") <= F.col("hi"))
        n_hit, n_tail = later.agg(F.count_if(F.col("first") <= F.col("hi")),
                                  F.count_if(F.col("first") > F.col("hi"))).first()
        movements = new
        if n_hit:
            movements = new.unionByName(self._movements(hit, new.columns), allowMissingColumns=True)
        self._write(movements, opening, batch, seq, 1)
        if n_hit:
            self._put_index(self._dead(hit), batch, seq, "replaced-1")
        if n_tail:
            self._move_tail(later.where(F.col("first") > F.col("hi")), batch, seq, new.columns)

    def _move_tail(self, tail: DataFrame, batch: str, seq: int, columns: list) -> None:
        """The chunks behind the new movements, from the products' new balances on."""
        written = self._index_part(batch, 1)
        base = written.groupBy(KEY).agg(F.max_by("end", "last").alias("base"))
        w = Window.partitionBy(KEY).orderBy("first")
        whole = Window.partitionBy(KEY)
        x = (tail.join(base, KEY).withColumn("rk", F.row_number().over(w))
             .withColumn("begin", F.col("base") + F.coalesce(
                 F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint")))
             .withColumn("bad", F.min(F.when(F.col("begin") < F.col("t"), F.col("rk"))).over(whole))
             .withColumn("same", F.min(F.when(F.col("begin") == F.col("start"), F.col("rk"))).over(whole)))
        x = L._checkpoint(x)
        # nothing changes from the first chunk on that starts as before, if none before it could refuse
        settled = F.col("same").isNotNull() & (F.col("bad").isNull() | (F.col("same") <= F.col("bad")))
        moved = x.where((F.col("bad").isNull() | (F.col("rk") < F.col("bad")))
                        & (~settled | (F.col("rk") < F.col("same"))))
        self._put_index(moved.withColumn("start", F.col("begin")).withColumn("end", F.col("begin") + F.col("s"))
                        .withColumn("clean", F.lit(True)), batch, seq, "moved")
        again = x.where(F.col("bad").isNotNull() & ~settled & (F.col("rk") >= F.col("bad")))
        if again.isEmpty():
            return
        opening = again.where(F.col("rk") == F.col("bad")).select(KEY, L.from_cents(F.col("begin")).alias("balance"))
        self._write(self._movements(again, columns), opening, batch, seq, 2)
        self._put_index(self._dead(again), batch, seq, "replaced-2")

    def _dead(self, entries: DataFrame) -> DataFrame:
        return entries.withColumn("live", F.lit(False))

    def _index_part(self, batch: str, part: int) -> DataFrame:
        """The entries of all chunks that a batch wrote as one part, committed or not."""
        return self.spark.read.parquet(f"{self.log.folder('index', batch)}/written=folded-{part}")

    def _part_rows(self, parts) -> DataFrame:
        """Rows as written, of (batch, part) pairs, committed or not."""
        return (self.spark.read.option("basePath", f"{self.log.path}/rows")
                .parquet(*[f"{self.log.folder('rows', batch)}/part={part}" for batch, part in parts])
                .withColumnRenamed("commit", "batch"))

    def _movements(self, entries: DataFrame, columns: list) -> DataFrame:
        """The movements of some chunks, without balances."""
        ids = {self.log.value(b): b for b in self.log.batches()}
        parts = [(ids[r["batch"]], r["part"]) for r in entries.select("batch", "part").distinct().collect()]
        rows = self._chosen(entries, parts)
        return rows.select(*[c for c in columns if c in rows.columns])

    def _chosen(self, entries: DataFrame, parts: list) -> DataFrame:
        """The rows of some chunks, which lie in these (batch, part): the fewer chunks, those or the others there, are
        looked up, so a batch that touches nearly all or next to none sends no stored row."""
        place = [KEY, *PLACE]
        chosen = L._checkpoint(entries.select(*place))
        there = self._index_part(*parts[0]).select(*place)
        for batch, part in parts[1:]:
            there = there.unionByName(self._index_part(batch, part).select(*place))
        others = L._checkpoint(there.join(chosen, place, "left_anti"))
        n_chosen, n_others = chosen.count(), others.count()
        rows = self._part_rows(parts)
        if n_others == 0:
            return rows
        how, some, n = ("left_anti", others, n_others) if n_others < n_chosen else ("left_semi", chosen, n_chosen)
        return rows.join(F.broadcast(some) if n <= FEW else some, place, how)
