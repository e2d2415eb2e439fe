"""Configuration of a scan: defaults, normal forms, and the domains that follow from the sources."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from urllib.parse import urlsplit


def _texts(x) -> list[str]:
    return [str(v).strip() for v in (x or []) if v is not None and str(v).strip()]


@dataclass
class Config:
    """Unknown keys are ignored; a relative output folder is taken from the folder of the file. paginas is the table of landed pages (url, html) that seeds are walked over; opener ("module:factory") is how addresses are fetched, without one they are only listed."""

    seeds: list[str] = field(default_factory=list)
    toegestane_domeinen: list[str] = field(default_factory=list)
    eigen_domeinen: list[str] = field(default_factory=list)
    bronnen: list[dict] = field(default_factory=list)
    detectors: dict[str, bool] = field(default_factory=dict)
    output_dir: str = "output"
    paginas: str = ""
    gemeenten: list[str] = field(default_factory=list)
    opener: str = ""
    opener_options: dict[str, str] = field(default_factory=dict)
    max_pages: int = 5000
    max_files: int = 20000
    max_depth: int = 8
    max_mb: int = 60
    delay_seconds: float = 1.0

    @classmethod
    def of(cls, d: Mapping, base: str = ".") -> Config:
        c = cls()
        for k in ("max_pages", "max_files", "max_depth", "max_mb"):
            setattr(c, k, int(d.get(k, getattr(c, k))))
        c.paginas = os.path.join(base, str(d["paginas"])) if d.get("paginas") else ""
        c.gemeenten = _texts(d.get("gemeenten"))
        c.opener, c.opener_options = str(d.get("opener") or ""), {str(k): str(v) for k, v in (d.get("opener_options") or {}).items()}
        c.delay_seconds = float(d.get("delay_seconds", c.delay_seconds))
        c.seeds, c.bronnen = _texts(d.get("seeds")), [b for b in d.get("bronnen") or [] if isinstance(b, Mapping)]
        c.eigen_domeinen = [x.lstrip("@").lower() for x in _texts(d.get("eigen_domeinen"))]
        c.detectors = {str(k): bool(v) for k, v in (d.get("detectors") or {}).items()}
        hosts = {h.lower() for u in c.seeds if (h := urlsplit(u).hostname)}
        c.toegestane_domeinen = sorted(hosts | {x.lower() for x in _texts(d.get("toegestane_domeinen"))})
        c.output_dir = os.path.normpath(os.path.join(base, str(d.get("output_dir", c.output_dir))))
        return c

    @classmethod
    def load(cls, path: str) -> Config:
        import yaml

        with open(path, encoding="utf-8") as f:
            return cls.of(yaml.safe_load(f) or {}, os.path.dirname(os.path.abspath(path)))
