"""Parameters of the operators, validated on the driver."""
