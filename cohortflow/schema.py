"""Role names shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class SurvivalSchema:
    """Names of the survival label and the optional id / group columns."""

    time: str = "time"
    status: str = "status"
    id: str | None = None
    group: str | None = None
    extra_keys: tuple[str, ...] = field(default_factory=tuple)

    def label_cols(self) -> list[str]:
        return [self.time, self.status]


DEFAULT = SurvivalSchema()
