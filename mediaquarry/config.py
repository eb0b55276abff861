"""Settings: defaults, overridden by a JSON object; an unknown key is an error. Also the derived thresholds."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace
from typing import ClassVar


@dataclass(frozen=True)
class Settings:
    # Defaults that results depend on.
    face_match_threshold: float = 0.42
    face_embedding_similarity_threshold: float = 0.57
    pet_embedding_similarity_threshold: float = 0.70
    pet_hash_distance_threshold: int = 14
    memory_min_items: int = 6
    video_frame_sample_seconds: float = 2.0
    video_max_analysis_frames: int = 12
    search_candidate_limit: int = 600
    fuzzy_minimum: int = 35
    page_size: int = 180
    auto_generate_memories: bool = True

    @classmethod
    def load(cls, text: str | None = None, **overrides) -> Settings:
        """Defaults, then a JSON object, then keyword overrides."""
        given = (json.loads(text) if text else {}) | overrides
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return replace(cls(), **given)

    def dump(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    # Cluster thresholds per kind: (floor, boost over the assignment threshold, cap, merge floor slack, merge margin).
    _CLUSTER: ClassVar[dict] = {"person": (0.68, 0.12, 0.82, 0.04, 0.05), "pet": (0.78, 0.08, 0.90, 0.02, 0.04)}

    def assign_cosine(self, kind: str) -> float:
        return self.pet_embedding_similarity_threshold if kind == "pet" else self.face_embedding_similarity_threshold

    def join_cosine(self, kind: str) -> float:
        floor, boost, cap, _, _ = self._CLUSTER[kind]
        return min(cap, max(floor, self.assign_cosine(kind) + boost))

    def merge_cosine(self, kind: str) -> float:
        floor, _, _, slack, margin = self._CLUSTER[kind]
        return max(floor - slack, self.join_cosine(kind) - margin)

    def join_hamming(self, kind: str) -> float:
        return min(float(self.pet_hash_distance_threshold), DISTINCT_HAMMING) if kind == "pet" else DISTINCT_HAMMING

    def merge_hamming(self, kind: str) -> float:
        return self.join_hamming(kind) + 2.0


# A vector or hash closer than this to a kept one adds nothing to a reference set.
DISTINCT_COSINE = 0.985
DISTINCT_HAMMING = 8.0

#: Label vocabularies.
CAT_LABELS = ("cat", "kitten")
DOG_LABELS = ("dog", "puppy")
PET_LABELS = (*CAT_LABELS, *DOG_LABELS, "bird", "horse", "rabbit", "hamster", "guinea pig", "ferret")
STOP_TAGS = ("image", "video", "gif", "live", "live photo", "live_photo", "face", "person", "pet", "animal")
