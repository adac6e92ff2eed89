"""A repository of model versions: commits, branches, checkout, merge, verification and exchange.

Payload (tensor bytes, deltas, permutations, file headers, manifests, commits) lives in the object store; ``commits``
and ``entries`` are tables derived from it for the graph queries; refs are an append-only table whose latest row per
name counts, so a crash between two writes never leaves a half-written pointer. Objects are written first, then
entries, then the commit's row: a commit that has a row here has all that it needs here.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical as C
from ..operators import alignment as A
from ..operators import graph, integrity, merge, transfer
from ..operators.cache import RecentBytes
from ..operators.intervals import VirtualFile, ranged
from ..operators.journal import Journal
from ..sources import files
from ..sources.objects import ObjectStore
from ..sources.tensorfile import METADATA, header_bytes, header_of, parse_header, read_tensors, write_tensors

COMMITS = "commit_id string, manifest_hash string, header_hash string, parent_ids array<string>, message string, author string, ts double"
ENTRIES = "manifest_hash string, name string, dtype string, shape array<bigint>, start bigint, end bigint, is_delta boolean, blob_hash string, residual_hash string, perm_hash string, base_commit_id string, raw_bytes bigint, stored_bytes bigint, content_hash string"
REFS = "name string, target string, seq bigint"
#: Deltas of a chain that are undone in one plan; then the tensors are checkpointed.
CHAIN = 4
#: Unsound objects that a report names.
LISTED = 1000
#: Bytes of tensors that an open file keeps.
CACHED_BYTES = 512 << 20


@dataclass
class Committed:
    commit_id: str
    statistics: dict


class Repository:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.objects, self.journal = ObjectStore(spark, root), Journal(spark, root)

    # tables

    def _table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        return self.spark.read.schema(schema).parquet(path) if files.exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def _append(self, name: str, schema: str, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")

    def commits(self) -> DataFrame:
        return self._table("commits", COMMITS).dropDuplicates(["commit_id"])

    def entries(self) -> DataFrame:
        return self._table("entries", ENTRIES).dropDuplicates(["manifest_hash", "name"])

    def refs(self) -> DataFrame:
        """name, target of all branches and of HEAD."""
        latest = self._table("refs", REFS).groupBy("name").agg(F.max_by("target", "seq").alias("target"))
        return latest.where("target is not null")

    # refs

    def _point(self, name: str, target: str | None) -> None:
        self._append("refs", REFS, [(name, target, time.time_ns())])

    def _target(self, name: str) -> str | None:
        row = self.refs().where(F.col("name") == name).first()
        return row["target"] if row else None

    def init(self) -> None:
        if self._target("HEAD") is None:
            self._point("HEAD", "ref: main")

    def head(self) -> tuple[str | None, str | None]:
        """(branch, commit); no branch if HEAD is detached."""
        held = self._target("HEAD")
        if held is None:
            return None, None
        if held.startswith("ref: "):
            return held[5:], self.branch_commit(held[5:])
        return None, held

    def branch_commit(self, name: str) -> str | None:
        return self._target(f"heads/{name}")

    def branches(self) -> list[str]:
        return [r[0][6:] for r in self.refs().where(F.col("name").startswith("heads/")).orderBy("name").select("name").collect()]

    def branch(self, name: str, ff_only: bool = False) -> None:
        """Set a branch to the current commit, whatever it was at unless ``ff_only``."""
        self.update_branch(name, self._resolve(None), ff_only)

    def update_branch(self, name: str, commit_id: str, ff_only: bool = False) -> None:
        old = self.branch_commit(name)
        if ff_only and old and self.common_ancestor(old, commit_id) != old:
            raise ValueError(f"{name} is no ancestor of the new commit")
        self._point(f"heads/{name}", commit_id)

    def _resolve(self, name: str | None) -> str:
        found = self.head()[1] if name is None else self.branch_commit(name) or name
        if not found or self.commits().where(F.col("commit_id") == found).isEmpty():
            raise ValueError(f"no commit {name or 'HEAD'}")
        return found

    def checkout(self, name: str, path: str | None = None) -> str:
        """Move HEAD to a branch, or else to a commit; write the model to ``path`` if given. Checked before it moves."""
        commit_id = self._resolve(name)
        self._point("HEAD", f"ref: {name}" if self.branch_commit(name) else commit_id)
        if path:
            self.materialize(commit_id, path)
        return commit_id

    # commits

    def create_commit(self, manifest_hash: str, message: str, parents: list[str] | None = None, author: str = "", header_hash: str | None = None) -> str:
        branch, current = self.head()
        parents = ([current] if current else []) if parents is None else parents
        at = time.time()
        commit_id = self.objects.put_bytes(C.commit_bytes(manifest_hash, parents, message, author, at))[0]
        self._append("commits", COMMITS, [(commit_id, manifest_hash, header_hash, parents, message, author, at)])
        self._point(f"heads/{branch}" if branch else "HEAD", commit_id)
        return commit_id

    def _store_manifest(self, rows: list[tuple], metadata: dict, header_hash: str | None = None) -> str:
        """``rows``: entries without the manifest's hash. The header is the file's own, so that checkout gives its very bytes."""
        names = [f.split()[0] for f in ENTRIES.split(", ")][1:]
        tensors = {r[0]: {k: v for k, v in zip(names[1:], r[1:], strict=True) if v is not None} for r in rows}
        manifest_hash = self.objects.put_bytes(C.manifest_bytes(tensors, metadata, header_hash))[0]
        if rows:
            self._append("entries", ENTRIES, [(manifest_hash, *r) for r in rows])
        return manifest_hash

    def commit(self, path: str, message: str = "", base: str | None = None, author: str = "", config: dict | None = None) -> Committed:
        """Commit a checkpoint file, at any path that Spark reaches: as deltas to the base (by default the current
        commit), or raw if there is none. A transaction that fails is closed; what it has stored stays as orphans."""
        base_id = self._resolve(base) if base else self.head()[1]
        tx = self.journal.begin("commit", {"path": path, "base": base_id})
        held: list[DataFrame] = []
        try:
            done = self._commit(path, message, base_id, author, config, tx, held)
        except BaseException:
            self.journal.close(tx)
            raise
        finally:
            for df in held:
                df.unpersist()
        self.journal.close(tx)
        return done

    def _commit(self, path: str, message: str, base_id: str | None, author: str, config: dict | None, tx: str, held: list[DataFrame]) -> Committed:
        head = header_of(self.spark, path)
        _, header = parse_header(head)
        target = read_tensors(self.spark, path).select("name", "dtype", "shape", "data").persist()
        held.append(target)
        if base_id:
            base = self.tensors(base_id).persist()
            held.append(base)
            entries, perms, facts = A.align_and_diff(base, target, config)
        else:
            entries, perms, facts = A.raw_entries(target), {}, []
        entries = entries.persist()
        held.append(entries)
        contents = target.select("name", F.sha2("data", 256).alias("content"))
        # facts of each tensor, no payload
        listed = entries.select("name", "dtype", "shape", "is_delta", F.sha2("blob", 256).alias("hash"), "raw_bytes", F.octet_length("blob").cast("long").alias("stored")).join(contents, "name").collect()
        perm_blobs = {n: A.perm_json(p) for n, p in perms.items()}
        small = dict.fromkeys([head, *perm_blobs.values()])
        named = self.spark.createDataFrame([(h,) for h in {r["hash"] for r in listed} | {C.digest(b) for b in small}], "hash string")
        self.journal.record_blobs(tx, named)
        self.objects.put(entries.select(F.col("blob").alias("data")))
        self.objects.put_bytes(*small)
        rows = []
        for r in listed:
            (a, b), delta = header[r["name"]]["data_offsets"], r["is_delta"]
            perm = C.digest(perm_blobs[r["name"]]) if delta and r["name"] in perm_blobs else None
            rows.append((r["name"], r["dtype"], list(r["shape"]), a, b, delta, None if delta else r["hash"], r["hash"] if delta else None, perm, base_id if delta else None, r["raw_bytes"], r["stored"], r["content"]))
        stats = A.statistics(entries, facts)
        manifest_hash = self._store_manifest(sorted(rows), header.get(METADATA) or {}, C.digest(head))
        self.journal.record_blobs(tx, self.spark.createDataFrame([(manifest_hash,)], "hash string"))
        commit_id = self.create_commit(manifest_hash, message, [base_id] if base_id else None, author, C.digest(head))
        self.journal.mark_committed(tx, commit_id)
        return Committed(commit_id, stats)

    def manifest(self, commit_id: str) -> tuple[str, DataFrame]:
        row = self.commits().where(F.col("commit_id") == commit_id).first()
        if row is None:
            raise KeyError(commit_id)
        return row["manifest_hash"], self.entries().where(F.col("manifest_hash") == row["manifest_hash"])

    def tensors(self, commit_id: str, names: DataFrame | None = None, depth: int = 1) -> DataFrame:
        """name, dtype, shape, data of a commit, or of some names of it; deltas are undone from the raw end of their
        chains upwards. A missing or altered object raises an error."""
        _, own = self.manifest(commit_id)
        if names is not None:
            own = own.join(names.select("name"), "name", "left_semi")
        out = self.objects.joined(own.where("not is_delta"), "blob_hash", "data").select("name", "dtype", "shape", "data")
        for base_id in sorted(r[0] for r in own.where("is_delta").select("base_commit_id").distinct().collect()):  # the bases of one model
            part = own.where(F.col("is_delta") & (F.col("base_commit_id") == base_id))
            part = self.objects.joined(self.objects.joined(part, "residual_hash", "blob"), "perm_hash", "perm")
            base = self.tensors(base_id, part.select("name"), depth + 1)
            out = out.unionAll(A.restored(part.select("name", "dtype", "shape", "is_delta", "blob", "perm"), base))
        return graph.checkpointed(out) if depth % CHAIN == 0 else out

    def _header(self, commit_id: str) -> bytes:
        manifest_hash, own = self.manifest(commit_id)
        manifest = C.read_manifest(self.objects.get(manifest_hash))
        if manifest["header"]:
            return self.objects.get(manifest["header"])
        rows = own.select("name", "dtype", "shape", "raw_bytes").collect()
        return header_bytes([tuple(r) for r in rows], manifest["metadata"] or None)[0]

    def materialize(self, commit_id: str, path: str) -> None:
        """Write a commit's file, byte for byte what was committed, to any path that Spark reaches; a tensor at a time."""
        _, own = self.manifest(commit_id)
        ordered = self.tensors(commit_id).join(own.select("name", "start"), "name").orderBy("start").select("data")

        def pieces():
            yield self._header(commit_id)
            for row in ordered.toLocalIterator():
                yield bytes(row[0])

        files.write(self.spark, path, pieces())

    def open(self, commit_id: str) -> VirtualFile:
        """A commit as a file that is read by ranges and never written. Places are looked up once; the tensors that a range
        meets are fetched when they are first read, and the most recent ones stay."""
        head = self._header(commit_id)
        _, own = self.manifest(commit_id)
        rows = own.select("name", "start", "end").collect()  # a row per tensor
        fetched = self.tensors(commit_id)
        places = [(0, len(head), None)] + sorted((r["start"] + len(head), r["end"] + len(head), r["name"]) for r in rows)

        def tensor(name: str) -> bytes:
            return bytes(fetched.where(F.col("name") == name).select("data").first()[0])

        return VirtualFile(ranged(places, head, RecentBytes(CACHED_BYTES, tensor).get), max(end for _, end, _ in places))

    def listing(self, name: str | None = None) -> list[tuple[str, int]]:
        """The files that stand for a commit, and their sizes."""
        commit_id = self._resolve(name)
        manifest_hash, own = self.manifest(commit_id)
        total = len(self._header(commit_id)) + (own.agg(F.sum("raw_bytes")).first()[0] or 0)
        return [("model", total), ("manifest.json", len(self.objects.get(manifest_hash))), ("commit_info.json", len(self.objects.get(commit_id)))]

    # history

    def log(self, start: str | None = None) -> DataFrame:
        """commit_id, message, author, ts, at (UTC), depth in the order of a breadth-first walk."""
        first = self.spark.createDataFrame([(self._resolve(start),)], "node string")
        walked = graph.history(first, graph.parent_edges(self.commits()))
        rows = walked.join(self.commits(), F.col("node") == F.col("commit_id"))
        return rows.select("commit_id", "message", "author", "ts", F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd HH:mm:ss").alias("at"), "depth").orderBy("depth", "rank")

    def common_ancestor(self, a: str, b: str) -> str | None:
        pair = self.spark.createDataFrame([(0, a, b)], "pair int, a string, b string")
        return graph.common_ancestors(pair, graph.parent_edges(self.commits())).first()["ancestor"]

    def merge(self, source: str, message: str | None = None, author: str = "") -> tuple[str, str]:
        """(status, commit) of merging a branch into the current one. Tensors are equal if their type, shape and content are,
        however they are stored. Entries keep the base that their delta is against,
        and places are laid out anew."""
        branch, head = self.head()
        other = self.branch_commit(source)
        if branch is None or head is None or other is None:
            raise ValueError("merging takes a branch with commits on either side")
        ancestor = self.common_ancestor(head, other)
        if ancestor == other:
            return "Already-up-to-date", head
        if ancestor == head:
            self._point(f"heads/{branch}", other)
            return "Fast-forward", other
        names = [f.split()[0] for f in ENTRIES.split(", ")][1:]
        fields = [n for n in names if n not in ("name", "start", "end")]
        side = lambda c: self.manifest(c)[1].select("name", F.struct(*fields).alias("entry"))
        base = side(ancestor) if ancestor else side(head).limit(0)
        kept = merge.three_way(side(head), side(other), base, by=["dtype", "shape", "content_hash"]).select("name", "entry.*").orderBy("name").collect()  # no payload
        rows = []
        _, ranges = header_bytes((r["name"], r["dtype"], r["shape"], r["raw_bytes"]) for r in kept)
        for r in kept:
            place = dict(zip(("start", "end"), ranges[r["name"]], strict=True))
            rows.append(tuple(place.get(n, list(r[n]) if n == "shape" else r[n] if n not in place else None) for n in names))
        manifest_hash = self._store_manifest(rows, {})
        return "Merged", self.create_commit(manifest_hash, message or f"Merge {source}", [head, other], author)

    # integrity and exchange

    def references(self, heads: list[str], bases: bool = False) -> DataFrame:
        """hash, type, ord of all that the commits reach. ``bases``: also through the commits that deltas are against."""
        seeds = self.spark.createDataFrame([("", h) for h in heads], "seed string, node string")
        return self.references_of(seeds, bases).drop("seed")

    def references_of(self, seeds: DataFrame, bases: bool = False) -> DataFrame:
        """seed, hash, type, ord of all that each seed's commits (seed, node) reach, in one walk."""
        reached = graph.walk(seeds, self._edges(bases)).select("seed", F.col("node").alias("commit_id")).distinct()
        return self.needed(reached, "seed")

    def _edges(self, bases: bool) -> DataFrame:
        edges = graph.parent_edges(self.commits())
        if not bases:
            return edges
        by_base = self.commits().join(self.entries().where("is_delta"), "manifest_hash").select(F.col("commit_id").alias("child"), F.col("base_commit_id").alias("parent")).distinct()
        return edges.unionByName(by_base.withColumn("pos", F.lit(999_999)))

    def needed(self, commits: DataFrame, *by: str) -> DataFrame:
        """hash, type, ord of the objects of some commits (commit_id), their own included; apart for each value of ``by``."""
        own = commits.join(self.commits(), "commit_id", "left")
        listed = own.select(*by, "manifest_hash").distinct().join(self.entries(), "manifest_hash")
        kinds = [(own, "commit_id", "commit"), (own, "manifest_hash", "manifest"), (listed, "blob_hash", "blob"), (listed, "perm_hash", "permutation"), (listed, "residual_hash", "residual"), (own, "header_hash", "header")]
        out = None
        for order, (rows, column, kind) in enumerate(kinds):
            rows = rows.select(*by, F.col(column).alias("hash")).where("hash is not null").distinct().withColumns({"type": F.lit(kind), "ord": F.lit(order)})
            out = rows if out is None else out.unionAll(rows)
        return out

    def verify(self, start: str | None = None) -> dict:
        """Counts by state, and up to ``LISTED`` of the missing and altered hashes; ``classified`` has them all."""
        if start is None and self.head()[1] is None:
            return {"is_valid": True, "errors": ["the repository has no commits"]}
        found = self.classified(start).persist()
        out = integrity.report(found).first().asDict()
        bad = found.where("state <> 'ok'").select("hash", "state").orderBy("hash").limit(LISTED).collect()
        found.unpersist()
        return out | {"missing": [h for h, s in bad if s == "missing"], "tampered": [h for h, s in bad if s == "tampered"]}

    def classified(self, start: str | None = None) -> DataFrame:
        """hash, type, state, size of all that a commit reaches."""
        return integrity.classify(self.references([self._resolve(start)]), self.objects.table())

    def pull(self, remote: Repository, branch: str = "main") -> int:
        """Fetch what a remote branch needs and is missing here, each object checked, and move the branch; objects moved.

        The walk over the remote's history stops at commits that have a row here: they have all that they need.
        Objects come first, then entries, then the commits' rows, and each step adds only what is missing,
        so a pull that stopped anywhere is finished by the next one.
        """
        target = remote.branch_commit(branch)
        if target is None:
            raise ValueError(f"the remote has no branch {branch}")
        if target == self.head()[1] and target == self.branch_commit(branch):
            return 0
        tx = self.journal.begin("pull", {"remote": remote.root, "branch": branch, "target": target})
        known = self.commits().select("commit_id")
        edges = remote._edges(bases=True).join(known.withColumnRenamed("commit_id", "parent"), "parent", "left_anti").select("child", "parent", "pos")
        seeds = self.spark.createDataFrame([(0, target)], "seed int, node string")
        ahead = graph.walk(seeds, edges).select(F.col("node").alias("commit_id")).join(known, "commit_id", "left_anti")
        commits = remote.commits().join(ahead, "commit_id", "left_semi").persist()
        wanted = transfer.missing(remote.needed(commits.select("commit_id")), self.objects.hashes()).persist()
        self.journal.record_blobs(tx, wanted)
        moved = self.objects.put(transfer.transfer(wanted, remote.objects.table()))
        lacking = transfer.missing(wanted, self.objects.hashes()).first()
        if lacking is not None:
            self.journal.close(tx)
            raise ValueError(f"the remote lacks the object {lacking[0]}")
        columns = lambda schema: [f.split()[0] for f in schema.split(", ")]
        entries = remote.entries().join(commits.select("manifest_hash"), "manifest_hash", "left_semi")
        entries = entries.join(self.entries().select("manifest_hash", "name"), ["manifest_hash", "name"], "left_anti")
        entries.select(*columns(ENTRIES)).write.mode("append").parquet(f"{self.root}/entries")
        commits.select(*columns(COMMITS)).write.mode("append").parquet(f"{self.root}/commits")
        wanted.unpersist()
        commits.unpersist()
        self._point(f"heads/{branch}", target)
        self.journal.mark_committed(tx, target)
        self.journal.close(tx)
        return moved

    def push(self, remote: Repository, branch: str = "main") -> int:
        return remote.pull(self, branch)

    def recover(self, older_than: float = 0.0) -> dict[str, int]:
        """Close transactions and delete half-written files that are at least ``older_than`` seconds old, so that
        live writers may be spared; counts of both."""
        found = self.journal.recover(older_than)
        return found | {"n_temporary": self._clean(time.time() - older_than)}

    def _clean(self, before: float) -> int:
        """Delete what writers that stopped left behind: uncommitted output of jobs and parts of files."""
        stale = []
        for folder in [self.root, *(f"{self.root}/{name}" for name in ("objects", "commits", "entries", "refs", "journal"))]:
            stale += [path for path, name, at in files.children(self.spark, folder) if at <= before and (name.startswith(("_temporary", ".spark-staging")) or name.endswith(".part"))]
        for path in stale:
            files.delete(self.spark, path)
        return len(stale)

    def orphans(self) -> DataFrame:
        from ..operators.journal import orphans

        heads = [r[0] for r in self.refs().where(F.col("name").startswith("heads/")).select("target").distinct().collect()]
        return orphans(self.objects.hashes(), self.references(heads, bases=True)) if heads else self.objects.hashes()

    def rebasin(self, a_path: str, b_path: str, out_path: str, alpha: float = 0.5, config: dict | None = None) -> dict[str, list[int]]:
        """Bring model B into A's order, mix the two and write the result; the permutations."""
        a, b = (read_tensors(self.spark, p).persist() for p in (a_path, b_path))
        try:
            moved, perms = A.rebasin(a, b, config)
            metadata = (parse_header(header_of(self.spark, a_path))[1].get(METADATA) or {}) | {"rebasin": "true", "alpha": json.dumps(alpha)}
            write_tensors(A.interpolate(a, moved, alpha), out_path, metadata)
        finally:
            a.unpersist()
            b.unpersist()
        return perms


def find_root(spark: SparkSession, start: str) -> str | None:
    """The folder at ``start`` or above it that holds a repository."""
    at = start.rstrip("/")
    while True:
        if files.exists(spark, f"{at}/refs"):
            return at
        above = at.rpartition("/")[0]
        if not above or above.endswith(("/", ":")) or above == at:
            return None
        at = above
