"""``python -m tidemark --batch N|all``

Exit codes: 0 published, 1 another expected failure, 2 the gate closed, 3 a balance failed,
64 wrong usage.
"""

from __future__ import annotations

import argparse
import logging
import re
import sys
from pathlib import Path

from tidemark import logs
from tidemark.config import load_settings
from tidemark.errors import GateClosedError, MissingFeedError, ReconciliationError, TidemarkError
from tidemark.plans.pipeline import run_batch, summary
from tidemark.plans.tables import TableStore
from tidemark.session import build_session
from tidemark.sources.files import Files
from tidemark.sources.generate import generate

log = logging.getLogger("tidemark.cli")


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        self.print_usage(sys.stderr)
        self.exit(64, f"{self.prog}: {message}\n")


def _batches(text: str) -> list[int] | None:
    if text == "all":
        return None
    if not text.isdigit() or int(text) < 1:
        raise argparse.ArgumentTypeError("a positive number or all")
    return [int(text)]


def batches_in(files: Files, raw_root: str) -> list[int]:
    """The batches below a raw root in any store; one without any is refused."""
    found = sorted(int(n.removeprefix("batch_")) for n in files.names(raw_root) if re.fullmatch("batch_[0-9]+", n))
    if not found:
        raise MissingFeedError(f"no batch below {raw_root}")
    return found


def main(argv: list[str] | None = None) -> int:
    parser = _Parser(prog="tidemark", description=__doc__)
    parser.add_argument("--batch", required=True, type=_batches, metavar="N|all")
    parser.add_argument("--config")
    parser.add_argument("--rules")
    parser.add_argument("--raw-root")
    parser.add_argument("--lakehouse-root")
    parser.add_argument("--reset", action="store_true", help="delete the published tables first")
    parser.add_argument("--log-level", default="INFO")
    args = parser.parse_args(argv)
    logs.setup(args.log_level)
    try:
        settings = load_settings(args.config, rules_path=args.rules, raw_root=args.raw_root, lakehouse_root=args.lakehouse_root)
        if "://" not in settings.raw_root and not (Path(settings.raw_root) / "batch_1").exists():
            generate(settings.raw_root, settings.seed)
        spark = build_session(master=settings.master, shuffle_partitions=settings.shuffle_partitions)
        if args.reset:
            TableStore(spark, settings.lakehouse_root).reset()
        wanted = args.batch or batches_in(Files(spark), settings.raw_root)
        for batch in wanted:
            print(summary(run_batch(spark, settings, batch)))
        kpi = TableStore(spark, settings.lakehouse_root).table("gold.kpi_loss_ratio_monthly")
        if kpi is not None:
            kpi.orderBy("month_start", "product_line").show(20, truncate=False)
        return 0
    except GateClosedError as e:
        log.error(str(e))
        return 2
    except ReconciliationError as e:
        log.error(str(e))
        return 3
    except TidemarkError as e:
        log.error(str(e))
        return 1
