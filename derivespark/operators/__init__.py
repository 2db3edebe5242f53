"""Operators on analysis datasets: DataFrame in, DataFrame out, lazy unless said otherwise."""
