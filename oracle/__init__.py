"""The same results in plain SQL, written independently of the Spark code."""

from oracle.sql import ORACLE

__all__ = ["ORACLE"]
