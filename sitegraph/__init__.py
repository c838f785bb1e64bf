"""sitegraph: site-structure analytics as Spark DataFrame transformations.

Every public function takes and returns DataFrames (or Column expressions);
nothing is collected to the driver.
"""

__version__ = "0.1.0"
