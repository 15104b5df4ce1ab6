"""Scalar functions as Column expressions; UDFs only where no built-in has the semantics."""
