"""Ledgerloom: a Spark-native reconciliation and analytics engine."""
