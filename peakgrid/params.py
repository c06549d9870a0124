"""Settings of a run, in one frozen place. Operators take the fields they need as arguments; from_ini reads a file of the same names."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Params:
    # peaks
    min_mz: float = 101.0
    max_mz: float = 1500.0
    min_peaks: int = 5
    min_mz_range: float = 250.0
    remove_precursor_tol: float = 1.5
    min_intensity: float = 0.01
    max_peaks_used: int = 50
    scaling: str = "off"
    mz_interval: float = 1.0
    cluster_charges: tuple[int, ...] = ()
    # hypervectors
    hd_dim: int = 2048
    hd_q: int = 16
    hd_id_flip_factor: float = 2.0
    # clustering
    cluster_alg: str = "hc_complete"
    eps: float = 0.6
    precursor_tol: float = 20.0
    precursor_tol_mode: str = "ppm"
    rt_tol: float | None = None
    fragment_tol: float = 0.05
    # incremental detection
    anomaly_threshold: str = "percentile"
    anomaly_percentile: float = 90.0
    anomaly_margin: float = 0.01
    anomaly_cap: float = 0.9
    anomaly_eps: float = 0.42
    no_history: str = "noise"
    batch_size: int = 10_000

    def __post_init__(self) -> None:
        if self.hd_dim % 32:
            raise ValueError("hd_dim must be a multiple of 32")
        if self.scaling not in ("off", "root", "log", "rank"):
            raise ValueError(f"unknown scaling {self.scaling!r}")
        if self.cluster_alg not in ("dbscan", "hc_single", "hc_complete", "hc_average"):
            raise ValueError(f"unknown cluster_alg {self.cluster_alg!r}")
        if self.no_history not in ("noise", "cluster"):
            raise ValueError(f"unknown no_history {self.no_history!r}")
        if self.precursor_tol_mode not in ("ppm", "Da"):
            raise ValueError(f"unknown precursor_tol_mode {self.precursor_tol_mode!r}")

    def with_(self, **changes: object) -> Params:
        return replace(self, **changes)  # type: ignore[arg-type]

    @classmethod
    def from_ini(cls, path: str, section: str = "DEFAULT") -> Params:
        """Settings from an ini file; names that it doesn't give keep their defaults, unknown names are an error."""
        file = configparser.ConfigParser()
        file.read(path)
        kinds = {f.name: f.type for f in fields(cls)}
        made: dict[str, object] = {}
        for name, text in file[section].items():
            if name not in kinds:
                raise ValueError(f"unknown setting {name!r}")
            kind = str(kinds[name])
            if "tuple" in kind:
                made[name] = tuple(int(x) for x in text.replace(",", " ").split())
            elif kind.startswith("int"):
                made[name] = int(text)
            elif kind.startswith("float"):
                made[name] = None if text.lower() == "none" else float(text)
            else:
                made[name] = text
        return cls(**made)  # type: ignore[arg-type]
