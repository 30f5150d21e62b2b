"""A consuming service: `python -m eventloom.service CONFIG --peer ADDRESS=NAME:PATH ... [--source FOLDER --checkpoint FOLDER]`.

It opens the log that the configuration names, recovers what its contracts miss from the
peers' logs, and then, if a source is given, takes in that folder's new event files.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from eventloom.model import ServiceIdentity
from eventloom.session import local_session
from eventloom.sources.config import load_config
from eventloom.sources.event_log import EventLog
from eventloom.streaming.pull import start_pull


def run(spark: SparkSession, config_path: str, peers: dict[str, tuple[str, str]], source: str | None = None, checkpoint: str | None = None) -> dict:
    """`peers` has the name and the log's path of each address. Returns the recovery's report."""
    config = load_config(config_path)
    log = EventLog(spark, config.wal_path, config.identity, config.contracts)
    logs = {address: EventLog(spark, path, ServiceIdentity(name, "", address)) for address, (name, path) in peers.items()}
    report = log.recover(logs)
    if source:
        start_pull(log, source, checkpoint or f"{config.wal_path}/pull").awaitTermination()
    return report


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("config")
    parser.add_argument("--peer", action="append", default=[], metavar="ADDRESS=NAME:PATH")
    parser.add_argument("--source")
    parser.add_argument("--checkpoint")
    own = parser.parse_args(args)
    peers = {}
    for peer in own.peer:
        address, _, rest = peer.partition("=")
        name, _, path = rest.partition(":")
        peers[address] = (name, path)
    spark = SparkSession.getActiveSession() or local_session()
    print(json.dumps(run(spark, own.config, peers, own.source, own.checkpoint)))


if __name__ == "__main__":
    main()
