"""python -m threadloom [version | inventory | reports | verify | stage | selftest | index] WORKSPACE"""

from __future__ import annotations

import json
import sys


def main(args: list[str]) -> int:
    from . import __version__

    if not args or args[0] in ("version", "--version"):
        print(f"threadloom {__version__}")
        return 0
    if len(args) != 2 or args[0] not in ("inventory", "reports", "verify", "stage", "selftest", "index"):
        print(__doc__)
        return 2
    from .plans import indexing, inventory, reports, selftest, staging, verify
    from .plans.workspace import open_workspace
    from .session import session

    ws = open_workspace(args[1])
    spark = session("threadloom")
    run = {
        "inventory": lambda: print(json.dumps(inventory.brief(inventory.inventory(spark, ws)), indent=2, default=str)),
        "reports": lambda: reports.phase1_reports(ws, inventory.load(ws)),
        "verify": lambda: print(f"PASS: {len(verify.verify(spark, ws))} checks"),
        "stage": lambda: print(f"STAGED files={len(staging.stage(spark, ws)['files'])}"),
        "selftest": lambda: print("PASS" if selftest.record(ws)["pass"] else "FAIL"),
        "index": lambda: print(json.dumps({"result": "VERIFIED_COMPLETE", "summary": indexing.build(spark, ws)["summary"]})),
    }[args[0]]
    indexing.guarded(ws, run)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
