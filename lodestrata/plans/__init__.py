"""Plan-level helpers: sessions, materialized tables, keyed joins, components."""
