"""All statements by query name."""

from oracle import articles, ingest, sources, streams, tracks

SQL = {**tracks.SQL, **articles.SQL, **ingest.SQL, **sources.SQL, **streams.SQL}
