"""Table health and run monitoring written as Spark DataFrame work.

Every public function takes DataFrames (or Columns) plus plain parameters and
returns a DataFrame (or Column).  Nothing is evaluated until the caller acts on
the result, and time always enters through an explicit ``as_of`` parameter.
"""
