"""python -m sluicebox: named queries, marts and single queries of the registry on the command line."""

from __future__ import annotations

import argparse
import json
import sys

#: Exit codes: done, bad arguments or input, a check failed, nothing to do.
DONE, BAD, FAILED, NOTHING = 0, 1, 3, 4


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sluicebox")
    sub = parser.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query", help="run a named query or a file of SQL over a directory of tables")
    q.add_argument("name")
    q.add_argument("data")
    m = sub.add_parser("marts", help="build the marts")
    m.add_argument("data")
    m.add_argument("out")
    t = sub.add_parser("test", help="run the data tests; exit code 3 if any finds rows")
    t.add_argument("data")
    i = sub.add_parser("manifest", help="split the sessions and print the manifest")
    i.add_argument("data")
    i.add_argument("--min-rows", type=int, default=1)
    args = parser.parse_args(argv)

    from .operators import dataset
    from .plans import lake, marts, views
    from .session import local_session
    from .sources import table

    spark = local_session("*")
    try:
        if args.command == "query":
            print(json.dumps(views.as_json_rows(views.run_query(spark, args.data, args.name))))
        elif args.command == "marts":
            print(json.dumps(marts.build_marts(spark, args.data, args.out)))
        elif args.command == "test":
            failed = [n for n in ("test_flag_rate_in_range", "test_flag_matches_signals", "test_hourly_reconciles", "test_shares_sum_to_100") if not lake.QUERIES[n](spark, args.data).isEmpty()]
            print(json.dumps({"failed": failed}))
            return FAILED if failed else DONE
        else:
            document = dataset.manifest(table(spark, args.data, "transactions"), args.min_rows)
            print(json.dumps(document))
            return DONE if document["sessions"] else NOTHING
    except (ValueError, FileNotFoundError) as error:
        print(error, file=sys.stderr)
        return BAD
    return DONE


if __name__ == "__main__":
    sys.exit(main())
