"""Plan building blocks shared by the operators: scratch tables, fixpoint loops, joins by size."""
