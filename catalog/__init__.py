"""Every operator as a query over the driver's tables, each with its SQL twin."""
