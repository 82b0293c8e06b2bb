"""Booking, inventory and payment-ledger jobs on Spark DataFrames."""
