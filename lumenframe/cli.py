"""Command line: one stage to a call, each reading what the one before has written.

python -m lumenframe.cli ingest FOLDER OUT | motion FRAMES OUT | motion-folder FOLDER OUT | fit FRAMES OUT | tune FRAMES OUT |
validate FRAMES OUT | register OUT MODEL... | evaluate MODEL OUT | upsample MODEL OUT | downsample FRAMES OUT | tiles FRAMES OUT |
batch OUT FRAMES... | params
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lumenframe.operators import components, movies
from lumenframe.params import Params
from lumenframe.plans import motion, report, session, sessions, tuning
from lumenframe.sources import avi, movie, store


def _params(path: str | None) -> Params:
    if not path:
        return Params()
    with open(path) as f:
        return Params.from_json(f.read())


def _shape(text: str) -> tuple[int, int]:
    h, w = text.lower().split("x")
    return int(h), int(w)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lumenframe", description=__doc__)
    sub = top.add_subparsers(dest="stage", required=True)
    two = ["src", "out"]
    for name, args in {**{n: two for n in ("ingest", "motion", "motion-folder", "fit", "tune", "validate", "downsample", "tiles", "evaluate", "upsample")}, "params": []}.items():
        p = sub.add_parser(name)
        for a in args:
            p.add_argument(a)
        p.add_argument("--shape", type=_shape, help="rows x columns, such as 128x128")
        p.add_argument("--params", help="JSON file")
        p.add_argument("--ssub", type=int, default=1)
        p.add_argument("--tsub", type=int, default=1)
        p.add_argument("--pattern", default="*.avi")
        p.add_argument("--decoder", help="module:function that decodes a compressed frame")
        p.add_argument("--spark-only", action="store_true", help="files are in a store that only Spark reads")
        p.add_argument("--budget", type=int, default=24, help="candidates that are fitted")
        p.add_argument("--at-once", type=int, default=2, help="fits side by side")
        p.add_argument("--frames", type=int, help="frames of the native recording")
        p.add_argument("--correct-motion", action="store_true")
    p = sub.add_parser("batch")
    p.add_argument("out")
    p.add_argument("sessions", nargs="+")
    p.add_argument("--shape", type=_shape, required=True)
    p.add_argument("--params")
    p.add_argument("--at-once", type=int, default=2)
    p = sub.add_parser("register")
    p.add_argument("out")
    p.add_argument("models", nargs="+")
    p.add_argument("--shape", type=_shape, required=True)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    if args.stage == "params":
        print(_params(args.params).to_json())
        return
    spark = spark or SparkSession.builder.appName(f"lumenframe-{args.stage}").getOrCreate()
    if args.stage == "ingest":
        if args.spark_only:
            frames = avi.read_folder(spark, args.src, args.pattern, ssub=args.ssub, tsub=args.tsub)
        else:
            frames = movie.read(spark, f"{args.src.rstrip('/')}/{args.pattern}", ssub=args.ssub, tsub=args.tsub, decoder=args.decoder)
        store.save_frames(frames, args.out)
    elif args.stage == "motion-folder":
        moved, shifts, _ = motion.correct_folder(spark, args.src, _params(args.params), ssub=args.ssub, tsub=args.tsub, pattern=args.pattern, decoder=args.decoder, spark_only=args.spark_only)
        store.save_frames(moved, args.out)
        shifts.write.mode("overwrite").parquet(f"{args.out.rstrip('/')}-shifts")
    elif args.stage == "tune":
        found = tuning.run_tuning(store.load_frames(spark, args.src), args.shape, _params(args.params), budget=args.budget, at_once=args.at_once)
        report.write(args.out, "tuning", {"sweep": found.sweep}, found.params, spark=spark)
        print(found.params.to_json())
    elif args.stage == "validate":
        rows = tuning.validate(store.load_frames(spark, args.src), args.shape, _params(args.params), out=args.out)
        report.write(args.out, "validation", {"runs": rows}, _params(args.params), spark=spark)
        print(rows.to_string(index=False))
    elif args.stage == "upsample":
        model = session.Model.load(spark, args.src)
        session.upsampled(model, args.shape, args.frames or model.traces.shape[1] * args.tsub, args.ssub).save(spark, args.out)
    elif args.stage == "tiles":
        store.save_tiles(movies.transposed(store.load_frames(spark, args.src)), args.out, args.shape, ssub=args.ssub, tsub=args.tsub)
    elif args.stage == "batch":
        params = _params(args.params)

        def one(path: str) -> int:
            model = session.fit(store.load_frames(spark, path), args.shape, params)
            model.save(spark, f"{args.out.rstrip('/')}/{path.rstrip('/').split('/')[-1]}")
            return model.count

        rows = tuning.run_batch(args.sessions, one, args.at_once)
        print(rows.to_string(index=False))
        if not rows["ok"].all():
            raise SystemExit(1)
    elif args.stage == "motion":
        moved, shifts, _ = motion.correct(store.load_frames(spark, args.src), args.shape, _params(args.params))
        store.save_frames(moved, args.out)
        shifts.write.mode("overwrite").parquet(f"{args.out.rstrip('/')}-shifts")
    elif args.stage == "downsample":
        frames = store.load_frames(spark, args.src)
        n_t = frames.agg(F.max("t") + 1).collect()[0][0]
        small = movies.block_mean(movies.long_of_frames(frames, args.shape[1]), args.ssub, args.tsub, n_t, *args.shape)
        store.save_frames(movies.frames_of(small), args.out)
        store.save_facts(spark, args.out, dims=[args.shape[0] // args.ssub, args.shape[1] // args.ssub], orig_dims=list(args.shape), orig_T=n_t, ssub=args.ssub, tsub=args.tsub)
    elif args.stage == "fit":
        params = _params(args.params)
        model = session.fit(store.load_frames(spark, args.src), args.shape, params, correct_motion=args.correct_motion)
        model.save(spark, args.out)
    elif args.stage == "evaluate":
        tables, _, _ = store.load_tables(spark, args.src)
        tables["metrics"].write.mode("overwrite").option("header", True).csv(args.out)  # a row for each component
    elif args.stage == "register":
        parts = [store.load_tables(spark, m)[0]["footprints"].withColumn("session", F.lit(i)) for i, m in enumerate(args.models)]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        components._ensure_checkpoints(spark)
        found = sessions.register(whole, args.shape)
        found.save(spark, args.out)


if __name__ == "__main__":
    main()
