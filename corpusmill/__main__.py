"""``python -m corpusmill merge|map|scan|skill|watch|apply|restore|serve``."""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import replace

from pyspark.sql import SparkSession


def main(args: list[str] | None = None) -> int:
    """Runs one command; 0 if it went well."""
    p = argparse.ArgumentParser(prog="corpusmill")
    sub = p.add_subparsers(dest="command", required=True)
    m = sub.add_parser("merge")
    m.add_argument("source")
    m.add_argument("out", nargs="?")
    m.add_argument("--skill", action="store_true")
    m.add_argument("--preset", default="archive")
    m.add_argument("--format")
    m.add_argument("--ordering")
    m.add_argument("--tokens", type=int)
    m.add_argument("--git-diff", action="store_true", default=None)
    m.add_argument("--git-log", type=int, metavar="N")
    g = sub.add_parser("map")
    g.add_argument("source")
    g.add_argument("--tokens", type=int, default=1024)
    sub.add_parser("scan").add_argument("source")
    w = sub.add_parser("watch")
    w.add_argument("source")
    w.add_argument("out")
    w.add_argument("--preset", default="archive")
    a = sub.add_parser("apply")
    a.add_argument("root")
    a.add_argument("--reply", required=True)
    a.add_argument("--yes", action="store_true")
    sub.add_parser("restore").add_argument("root")
    sub.add_parser("serve")
    o = p.parse_args(args)
    if o.command == "apply":
        from corpusmill.operators import patch

        with open(o.reply, newline="") as f:
            ready = patch.preview(o.root, patch.parse_reply(f.read()))
        for x in ready:
            print(f"{x.action} {x.path}" + (f": {x.note}" if x.note else ""))
        if o.yes:
            for path, result in patch.apply(o.root, ready):
                print(f"{result} {path}")
        return int(not all(x.ok for x in ready))
    if o.command == "restore":
        from corpusmill.operators import patch

        print(*patch.restore(o.root), sep="\n")
        return 0
    spark = SparkSession.builder.appName("corpusmill").getOrCreate()
    if o.command == "serve":
        from corpusmill.rpc import serve

        serve(spark)
        return 0
    from corpusmill.plans.merge import FORMATS, PRESETS, merge, repo_map, scan_report, watch_tree, write_skill
    from corpusmill.sources.remote import output_name, resolve, settings

    try:
        root, held = resolve(o.source, os.environ.get("CORPUSMILL_TOKEN", ""))
    except (ValueError, RuntimeError) as e:
        print(e, file=sys.stderr)
        return 2
    options, warning = settings(root)
    if warning:
        print(warning, file=sys.stderr)
    if o.command == "map":
        print(repo_map(spark, root, o.tokens, options))
    elif o.command == "scan":
        report, total = scan_report(spark, root, options)
        for r in report.toLocalIterator():
            print(r.rel, r.size, r.tokens, sep="\t")
        print(f"{total.files} files, {total.bytes} bytes, ~{total.tokens} tokens")
    elif o.command == "watch":
        watch_tree(spark, root, o.out, PRESETS[o.preset], options).awaitTermination()
    else:
        given = {k: v for k, v in (("format", o.format), ("ordering", o.ordering), ("token_budget", o.tokens), ("git_diff", o.git_diff), ("git_log", o.git_log)) if v is not None}
        chosen = replace(PRESETS[o.preset], **given)
        out = o.out or output_name(root, FORMATS[chosen.format]).rpartition(".")[0]
        r = merge(spark, root, out, chosen, options, progress=lambda what, n: print(f"{what}: {n}", file=sys.stderr))
        print(f"merged {r.merged} of {r.files} files, ~{r.tokens} tokens, {r.secrets} secrets masked:", *r.parts)
        if o.skill:
            print(write_skill(root, r))
    if held:
        held.cleanup()
    return 0


if __name__ == "__main__":
    sys.exit(main())
