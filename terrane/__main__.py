"""Command line.

``python -m terrane list`` names the queries, ``query NAME FOLDER OUTPUT`` writes a
query's rows and ``run CONFIG`` runs a study.  Every recipe is a command of its own with a
JSON or YAML description: ``extract``, ``radiomics``, ``icc``, ``retest``, ``dice``,
``compare``, ``delong``, ``cv``, ``model``, ``merge``, ``dicom_info``, ``sort_dicom``,
``preprocess``, ``view``, ``habitat``.  ``check RECIPE CONFIG`` checks a description,
``example RECIPE`` prints one to start from, ``migrate CONFIG OUTPUT`` renames earlier keys.
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession


def main(args: list[str] | None = None) -> None:
    from .plans import recipes

    parser = argparse.ArgumentParser(prog="terrane")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    commands.add_parser("run").add_argument("config")
    for name, names in {"query": ("name", "folder", "output"), "check": ("recipe", "config"), "example": ("recipe",), "migrate": ("config", "output")}.items():
        command = commands.add_parser(name)
        for argument in names:
            command.add_argument(argument)
    for name in recipes.RECIPES:
        command = commands.add_parser(name)
        command.add_argument("config")
        command.add_argument("--output")
    given = parser.parse_args(args)
    from . import catalog

    if given.command == "list":
        print("\n".join(sorted(catalog.queries())))
    elif given.command == "check":
        recipes.check_config(given.recipe, given.config)
        print(f"{given.config} describes {given.recipe}")
    elif given.command == "example":
        print(json.dumps(recipes.example(given.recipe), indent=1))
    elif given.command == "migrate":
        Path(given.output).write_text(json.dumps(recipes.migrate(recipes.read_config(given.config)), indent=1))
    else:
        spark = SparkSession.builder.appName("terrane").getOrCreate()
        if given.command == "run":
            from .plans.workflows import run_config

            run_config(spark, given.config).write.format("noop").mode("overwrite").save()
        elif given.command == "query":
            catalog.queries()[given.name](spark, given.folder).write.mode("overwrite").parquet(given.output)
        else:
            config = recipes.read_config(given.config) | ({"output": given.output} if given.output else {})
            found = recipes.run(spark, given.command, config)
            if not config.get("output"):
                found.show(50, truncate=False)


if __name__ == "__main__":
    main()
