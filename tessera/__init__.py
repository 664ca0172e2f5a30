"""Tessera: document- and change-intelligence analytics as Spark DataFrame operators."""
