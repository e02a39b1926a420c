"""Fleet usage analytics expressed as Spark DataFrame work.

Raw audit logs and inventory snapshots from many application instances become
normalised tables, facts, serving views and parameterised analytic queries.
Every public function takes DataFrames and returns a lazy DataFrame (or a
Column), so Catalyst plans the whole pipeline.
"""

__version__ = "0.1.0"
