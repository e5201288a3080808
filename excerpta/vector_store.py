"""Vector artifacts of a library: deduplicated objects, per-snapshot mappings, coverage."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from excerpta import schemas
from excerpta.errors import VectorError
from excerpta.functions import vectors as vec
from excerpta.functions.identity import canonical_json
from excerpta.operators import vectors
from excerpta.storage import Revisions

CATALOG = "vector-catalog"
PARTS = ("objects", "mappings")


class VectorStore:
    def __init__(self, library):
        self.library = library
        self.spark = library.spark
        self.folder = library.folder
        self._revisions = Revisions(self.folder, CATALOG, lambda: {"version": 1, "artifacts": []})

    def catalog(self):
        return self._revisions.read()

    def states(self, artifact_id=None):
        """``artifact_id, part, state`` of every stored or cataloged artifact, or of one: present, missing, altered (other
        files or bytes than at its build) or unlisted (stored, but in no catalog entry)."""
        listed = [a for a in self.catalog()["artifacts"] if artifact_id in (None, a["artifact_id"])]
        rows = [(a["artifact_id"], part, *a["files"][part]) for a in listed for part in PARTS]
        cataloged = self.spark.createDataFrame(rows, vectors.ARTIFACT)
        stored = self.spark.createDataFrame([], vectors.ARTIFACT)
        name = "artifact=*" if artifact_id is None else f"artifact={artifact_id}"
        if self.folder.exists("vectors"):
            files = vectors.artifact_files(self.spark, [self.folder.path("vectors", part, name) for part in PARTS if self._holds(part, artifact_id)])
            stored = stored if files is None else vectors.stored_artifacts(files)
        return vectors.artifact_states(cataloged, stored)

    def _holds(self, part, artifact_id):
        if artifact_id is not None:
            return self.folder.exists("vectors", part, f"artifact={artifact_id}")
        return any(n.startswith("artifact=") for n in self.folder.names("vectors", part))

    def _file_sizes(self, artifact_id):
        listed = {part: self.folder.listing("vectors", part, f"artifact={artifact_id}") for part in PARTS}
        sizes = {part: [size for path, size, _ in found if path.endswith(".parquet")] for part, found in listed.items()}
        return {part: [len(found), sum(found)] for part, found in sizes.items()}

    def _objects(self, profile_id):
        """Vectors of one profile from every published artifact, or None."""
        wanted = [a["artifact_id"] for a in self.catalog()["artifacts"] if a["profile_id"] == profile_id and a["new_objects"]]
        if not wanted:
            return None
        return self.spark.read.schema(schemas.VECTOR_OBJECT).parquet(
            *(self.folder.path("vectors", "objects", f"artifact={name}") for name in wanted)
        )

    def _record(self, snapshot_id, profile_id):
        for record in self.catalog()["artifacts"]:
            if (record["snapshot_id"], record["profile_id"]) == (snapshot_id, profile_id):
                return record
        return None

    def _inputs(self, snapshot_id, profile):
        manifest = self.library.opened(snapshot_id)
        return vectors.inputs(self.library.table(snapshot_id, "chunk", manifest), profile, "document_id")

    def preview(self, snapshot_id, profile):
        profile = vec.checked_profile(profile)
        name = vec.profile_id(profile)
        exists = self._record(snapshot_id, name) is not None
        found = vectors.preview(self._inputs(snapshot_id, profile), self._objects(name)).first().asDict()
        if exists:
            found.update(new_inputs=0, new_input_chars=0, planned_calls=0)
        return {"profile_id": name, "already_exists": exists, "batch_size": vec.BATCH_SIZE, **found}

    def build(self, snapshot_id, profile, embedder):
        """Embed what no artifact of this profile holds yet; publish all or nothing."""
        profile = vec.checked_profile(profile)
        name = vec.profile_id(profile)
        vectors.checked_embedder(embedder, profile)
        existing = self._record(snapshot_id, name)
        if existing:
            return {**existing, "already_exists": True, "submitted_unique_inputs": 0}
        artifact = uuid.uuid4().hex
        mapped = self._inputs(snapshot_id, profile)
        stored = self._objects(name)
        object_path = self.folder.path("vectors", "objects", f"artifact={artifact}")
        map_path = self.folder.path("vectors", "mappings", f"artifact={artifact}")
        try:
            made = vectors.embed(vectors.missing_inputs(mapped, stored), profile, embedder)
            made.withColumn("created_in_artifact", F.lit(True)).write.parquet(object_path)
            mapped.select("chunk_id", "vector_object_id").write.parquet(map_path)
            statistics = vectors.stats(mapped, stored, profile["dimensions"]).first().asDict()
            record = {
                "artifact_id": artifact,
                "snapshot_id": snapshot_id,
                "snapshot_manifest_sha256": self.library._record(snapshot_id)["manifest_sha256"],
                "profile_id": name,
                "profile": profile,
                "adapter": dict(embedder.adapter_identity),
                "mode": "offline_simulated" if embedder.simulated else "real_provider",
                "new_objects": statistics["new_objects"],
                "statistics": statistics,
                "files": self._file_sizes(artifact),
            }
            self._check(record)
            self._revisions.change(lambda catalog: self._with_record(catalog, record))
        except BaseException as error:
            self.folder.remove("vectors", "objects", f"artifact={artifact}")
            self.folder.remove("vectors", "mappings", f"artifact={artifact}")
            if isinstance(error, VectorError) or not isinstance(error, Exception):
                raise
            raise VectorError("the embedder failed; nothing was retried or published") from error
        return {**record, "already_exists": False, "submitted_unique_inputs": statistics["new_objects"]}

    @staticmethod
    def _with_record(catalog, record):
        """The catalog and one more artifact; another build may have published the same snapshot and profile meanwhile."""
        own = (record["snapshot_id"], record["profile_id"])
        if any((r["snapshot_id"], r["profile_id"]) == own for r in catalog["artifacts"]):
            raise VectorError("vectors of this profile were built for the snapshot meanwhile")
        rows = sorted([*catalog["artifacts"], record], key=lambda r: (r["snapshot_id"], r["profile_id"]))
        return {**catalog, "artifacts": rows}

    def _check(self, record):
        """Mapping, objects and statistics of one artifact against its snapshot."""
        snapshot_id, profile = record["snapshot_id"], vec.checked_profile(record["profile"])
        if self.library._record(snapshot_id)["manifest_sha256"] != record["snapshot_manifest_sha256"]:
            raise VectorError("the artifact is bound to another manifest")
        if vec.profile_id(profile) != record["profile_id"]:
            raise VectorError("the artifact's profile identity is wrong")
        expected = self._inputs(snapshot_id, profile)
        mapping = self._mapping(record)
        objects_ = self._objects(record["profile_id"])
        fresh = self.spark.read.schema(schemas.VECTOR_OBJECT).parquet(
            self.folder.path("vectors", "objects", f"artifact={record['artifact_id']}")
        )
        if self._record(snapshot_id, record["profile_id"]) is None:
            objects_ = fresh if objects_ is None else objects_.unionByName(fresh)
        elif objects_ is None:
            objects_ = fresh
        faults = vectors.mapping_faults(expected.select("chunk_id"), mapping, objects_)
        wrong = expected.join(mapping.withColumnRenamed("vector_object_id", "_mapped"), "chunk_id").filter(
            "vector_object_id <> _mapped"
        )
        size = objects_.filter(F.col("payload_byte_size") != profile["dimensions"] * 8)
        broken = [row["check"] for row in faults.filter("violations > 0").collect()]
        broken += ["mapping_input_differs"] * bool(wrong.limit(1).count())
        broken += ["payload_size"] * bool(size.limit(1).count())
        if fresh.count() != record["new_objects"]:
            broken.append("new_objects")
        if broken:
            raise VectorError("vector audit failed: " + ", ".join(sorted(broken)))

    def _mapping(self, record):
        return self.spark.read.schema(schemas.VECTOR_MAP).parquet(
            self.folder.path("vectors", "mappings", f"artifact={record['artifact_id']}")
        )

    def verify(self, snapshot_id, profile_id):
        record = self._record(snapshot_id, profile_id)
        if record is None:
            raise VectorError("no vectors of this profile were built for the snapshot")
        wrong = self.states(record["artifact_id"]).filter("state <> 'present'").collect()
        if wrong:
            raise VectorError("stored vectors: " + ", ".join(sorted(f"{r['part']} {r['state']}" for r in wrong)))
        self._check(record)
        digest = hashlib.sha256(canonical_json(record).encode()).hexdigest()
        return {"verified": True, "simulated": record["mode"] == "offline_simulated", "artifact_sha256": digest, **record}

    def load(self, snapshot_id, profile_id):
        """Verified ``(chunk_id, vector)`` of a whole snapshot, and the artifact's record."""
        record = self.verify(snapshot_id, profile_id)
        held = self._objects(profile_id)
        if held is None:
            raise VectorError("the artifact has no vectors")
        rows = self._mapping(record).join(held.dropDuplicates(["vector_object_id"]), "vector_object_id")
        return record, rows.select("chunk_id", vec.decode_vector("payload").alias("vector"))

    def readiness(self, profile, running=None):
        """ready / mismatch / missing for every cataloged snapshot."""
        snapshots = [(r["snapshot_id"],) for r in self.library.catalog()["snapshots"]]
        artifacts = [(a["snapshot_id"], a["profile_id"]) for a in self.catalog()["artifacts"]]
        rows = vectors.snapshot_readiness(
            self.spark.createDataFrame(snapshots, "snapshot_id string"),
            self.spark.createDataFrame(artifacts, "snapshot_id string, profile_id string"),
            vec.profile_id(profile),
            running,
        )
        return {row["snapshot_id"]: row["vector_status"] for row in rows.collect()}

    def document_readiness(self, snapshot_id, profile):
        """Coverage of every document of a snapshot, as a DataFrame."""
        profile = vec.checked_profile(profile)
        artifacts = self.catalog()["artifacts"]
        chosen = vec.profile_id(profile)
        others = {a["profile_id"]: a["profile"] for a in artifacts if a["profile_id"] != chosen}
        frames = [
            self._objects(name).select(F.lit(name).alias("profile_id"), "vector_object_id")
            for name in (chosen, *others)
            if self._objects(name) is not None
        ]
        stored = self.spark.createDataFrame([], "profile_id string, vector_object_id string")
        for frame in frames:
            stored = stored.unionByName(frame)
        chunks = self.library.table(snapshot_id, "chunk", self.library.opened(snapshot_id))
        return vectors.document_coverage(chunks, stored, profile, list(others.values()))
