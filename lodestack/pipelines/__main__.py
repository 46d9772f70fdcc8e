"""python -m lodestack.pipelines {mri,radiographs,ct} --config FILE [--set a.b=value ...] [--stage S] [--version V]"""

from __future__ import annotations

import argparse
import sys

from .. import config
from ..session import build, ship
from ..sinks import logs


def main(args=None) -> int:
    p = argparse.ArgumentParser(prog="lodestack.pipelines")
    p.add_argument("pipeline", choices=("mri", "radiographs", "ct"))
    p.add_argument("--config", required=True)
    p.add_argument("--set", action="append", default=[])
    p.add_argument("--stage", default="all")
    p.add_argument("--cohort")
    p.add_argument("--version", default="v1.0.0")
    a = p.parse_args(args)
    from . import ct, mri, radiographs

    try:
        cfg = config.load(a.config, a.set)
        logs.configure(cfg.log_level, cfg.json_logs)
        spark = build()
        ship(spark)
        if a.pipeline == "mri":
            mri.run(spark, cfg, a.stage, a.version)
        elif a.pipeline == "radiographs":
            radiographs.run(spark, cfg, version=a.version)
        else:
            ct.run(spark, cfg, **({"cohort_name": a.cohort} if a.cohort else {}), version=a.version)
    except (FileNotFoundError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
